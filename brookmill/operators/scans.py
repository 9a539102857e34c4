"""Numbers and window functions in an order of rows, where one group may hold most rows.

Rows are sorted into even pieces by group and order, so that a large group
takes many pieces and a piece holds many small groups. Window functions run
within the pieces. What crosses their bounds is carried: a piece's first and
last group are the only ones that may go on in another piece, so all that is
carried is a few rows and sums for each piece, never for each group.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brookmill.sources.written import passing, written

#: The low bits of monotonically_increasing_id: a row's place within its partition.
PLACE_BITS = (1 << 33) - 1


def in_pieces(df: DataFrame, order: list[Column], pieces: int | None = None, label: str = "pieces") -> DataFrame:
    """df as a written table, sorted by order over even pieces, with scan_piece and scan_place (from 0, within the piece).

    There are as many pieces as shuffle partitions unless `pieces` says otherwise.
    The numbers are part of the table, so that they stay whoever reads it again.
    """
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    return written(rows.withColumns({"scan_piece": F.spark_partition_id(), "scan_place": F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE_BITS))}), label)


def numbered(df: DataFrame, order: list[Column], name: str, pieces: int | None = None, label: str = "numbered") -> DataFrame:
    """df with each row's number, from 1, in the given order; equal rows are numbered in any order.

    The rows before each piece are added up from one count a piece.
    """
    rows = in_pieces(df, order, pieces, label)
    counts = rows.groupBy("scan_piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("scan_piece").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("scan_piece", F.coalesce(before, F.lit(0)).alias("scan_start"))
    return rows.join(F.broadcast(starts), "scan_piece").withColumn(name, F.col("scan_start") + F.col("scan_place") + 1).select(*df.columns, name)


@dataclass(frozen=True)
class Scan:
    """One result of `ordered`; made by the functions below."""

    kind: str
    value: Column | None = None
    back: int = 0
    ahead: int = 0
    default: object = None


def lag(value: str, n: int = 1, default: object = None) -> Scan:
    return Scan("lag", F.col(value), back=n, default=default)


def lead(value: str, n: int = 1, default: object = None) -> Scan:
    return Scan("lead", F.col(value), ahead=n, default=default)


def first(value: str) -> Scan:
    return Scan("first", F.col(value))


def running_sum(value: Column) -> Scan:
    """The sum up to and with this row; give exact numbers (integers, decimals), whose sums don't depend on their order."""
    return Scan("running_sum", value)


def moving_sum(value: Column, back: int, ahead: int = 0) -> Scan:
    """The sum from `back` rows before to `ahead` rows after."""
    return Scan("moving_sum", value, back, ahead)


def row_number() -> Scan:
    return Scan("row_number")


def rank() -> Scan:
    return Scan("rank")


def percent_rank() -> Scan:
    return Scan("percent_rank")


def ntile(n: int) -> Scan:
    return Scan("ntile", back=0, default=n)


def _tile(number: Column, total: Column, n: int) -> Column:
    size, larger = F.call_function("div", total, F.lit(n)), total % n
    upto = larger * (size + 1)
    rest = larger + F.call_function("div", number - 1 - upto, F.greatest(size, F.lit(1))) + 1
    return F.when(number <= upto, F.call_function("div", number - 1, size + 1) + 1).otherwise(rest).cast("int")


def ordered(df: DataFrame, by: list[str], order: list[str], scans: dict[str, Scan], pieces: int | None = None) -> DataFrame:
    """df with a column for each of scans: window functions over the rows of equal `by` columns in ascending order of `order`.

    Results are those of Spark's window functions with that partition and order,
    null keys being a group and nulls coming first in the order. Where rows tie
    in the order, all but rank and percent_rank depend on which comes first, as
    in Spark. No task has more rows than a piece, and the few rows around it,
    whatever a group's size.
    """
    clash = {c for c in df.columns if c.startswith("scan_")} | (set(scans) & set(df.columns))
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the scan's own")
    back, ahead = max(s.back for s in scans.values()), max(s.ahead for s in scans.values())
    sums = {name: s.value for name, s in scans.items() if s.kind == "running_sum"}
    firsts = {name: s.value for name, s in scans.items() if s.kind == "first"}
    with passing() as tables:
        rows = in_pieces(df.withColumn("scan_order", F.struct(*order)), [F.col(c) for c in [*by, *order]], pieces, "scan-rows")
        carried, halo = _carried(rows, by, sums, firsts, back, ahead)
        tables.keep(*[t for t in (rows, carried, halo) if t is not None])
    everything = rows.withColumn("scan_side", F.lit(0))
    if halo is not None:
        everything = everything.unionByName(halo)
    group = W.partitionBy("scan_piece", *by)
    line, whole = group.orderBy("scan_side", "scan_place"), group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = line.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = lambda c: F.when(F.col("scan_side") == 0, c)
    local = {"scan_number": F.sum(own(F.lit(1))).over(upto), "scan_total": F.sum(own(F.lit(1))).over(whole)}
    for name, s in scans.items():
        if s.kind == "lag":
            local[name] = F.lag(s.value, s.back, s.default).over(line)
        elif s.kind == "lead":
            local[name] = F.lead(s.value, s.ahead, s.default).over(line)
        elif s.kind == "moving_sum":
            local[name] = F.sum(s.value).over(line.rowsBetween(-s.back, s.ahead))
        elif s.kind == "running_sum":
            local[name] = F.sum(own(s.value)).over(upto)
        elif s.kind == "first":
            local[name] = F.min_by(own(s.value), own(F.col("scan_place"))).over(whole)
    if any(s.kind in ("rank", "percent_rank") for s in scans.values()):
        local["scan_rank"] = F.rank().over(W.partitionBy("scan_piece", *by, "scan_side").orderBy("scan_order"))
    out = everything.select("*", *[c.alias(name) for name, c in local.items()]).where("scan_side = 0")
    same = functools.reduce(lambda a, c: a & out[c].eqNullSafe(carried[c]), by, out["scan_piece"] == carried["scan_piece"])
    out = out.join(F.broadcast(carried), same, "left").select(*[out[c] for c in out.columns], *[carried[c] for c in carried.columns if c not in ("scan_piece", *by)])
    before = F.coalesce("scan_before", F.lit(0))
    number, total = F.col("scan_number") + before, F.coalesce("scan_all", "scan_total")
    if "scan_rank" in local:
        at = F.col("scan_rank") + before - F.when(F.col("scan_rank") == 1, F.coalesce("scan_tied", F.lit(0))).otherwise(0)
    results = {}
    for name, s in scans.items():
        if s.kind == "running_sum":
            sofar = F.col(f"scan_sum_{name}")
            results[name] = F.when(sofar.isNull(), F.col(name)).otherwise(F.coalesce(F.col(name), F.lit(0)) + sofar)
        elif s.kind == "first":
            results[name] = F.when(F.col("scan_before") > 0, F.col(f"scan_first_{name}")).otherwise(F.col(name))
        elif s.kind == "row_number":
            results[name] = number.cast("int")
        elif s.kind == "rank":
            results[name] = at.cast("int")
        elif s.kind == "percent_rank":
            results[name] = F.when(total > 1, (at - 1) / F.greatest(total - 1, F.lit(1))).otherwise(0.0)
        elif s.kind == "ntile":
            results[name] = _tile(number, total, s.default)
        else:
            results[name] = F.col(name)
    return out.select(*df.columns, *[c.alias(name) for name, c in results.items()])


def _carried(rows: DataFrame, by: list[str], sums: dict[str, Column], firsts: dict[str, Column], back: int, ahead: int) -> tuple[DataFrame, DataFrame | None]:
    """What pieces take over from others, one row for each piece of a group that has several, and the rows around each.

    The second table has rows of the pieces before (scan_side -1) and after (1), under the number of the piece that needs them.
    """
    key = F.struct(*by)
    ends = rows.groupBy("scan_piece").agg(F.array_distinct(F.array(F.min_by(key, "scan_place"), F.max_by(key, "scan_place"))).alias("keys"))
    ends = ends.select("scan_piece", F.explode("keys").alias("key")).withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1").select("scan_piece", "key.*")
    ends = written(ends, "scan-ends")
    spread = _of(rows, ends, by, [])
    edges = spread.groupBy("scan_piece", *by).agg(
        F.count("*").alias("n"), F.min("scan_place").alias("low"), F.max("scan_place").alias("high"), F.min_by("scan_order", "scan_place").alias("least"), F.max_by("scan_order", "scan_place").alias("most"),
        *[F.sum(c).alias(f"sum_{name}") for name, c in sums.items()], *[F.min_by(c, "scan_place").alias(f"first_{name}") for name, c in firsts.items()])
    edges = written(edges, "scan-edges")
    pieces = W.partitionBy(*by).orderBy("scan_piece")
    before = pieces.rowsBetween(W.unboundedPreceding, -1)
    # rows of the pieces before that tie with a piece's first row
    last_ties = _of(rows, edges, by, ["most"]).where(F.col("scan_order") == F.col("most")).groupBy("scan_piece", *by, "most").agg(F.count("*").alias("ties"))
    meeting = last_ties.select("scan_piece", *by, F.col("most").alias("at"), "ties", F.lit(False).alias("asks")).unionByName(edges.select("scan_piece", *by, F.col("least").alias("at"), F.lit(0).cast("bigint").alias("ties"), F.lit(True).alias("asks")))
    tied = meeting.withColumn("scan_tied", F.sum("ties").over(W.partitionBy(*by, "at").orderBy("scan_piece").rangeBetween(W.unboundedPreceding, -1))).where("asks").select("scan_piece", *by, "scan_tied")
    totals = edges.select(
        "scan_piece", *by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("scan_before"), F.sum("n").over(W.partitionBy(*by)).alias("scan_all"),
        *[F.sum(f"sum_{name}").over(before).alias(f"scan_sum_{name}") for name in sums], *[F.first(f"first_{name}").over(pieces.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(f"scan_first_{name}") for name in firsts])
    same = functools.reduce(lambda a, c: a & totals[c].eqNullSafe(tied[c]), by, totals["scan_piece"] == tied["scan_piece"])
    carried = written(totals.join(tied, same, "left").select(*[totals[c] for c in totals.columns], tied["scan_tied"]), "scan-carried")
    if not back and not ahead:
        return carried, None
    whole = F.struct(*rows.columns)
    near = _of(rows, edges, by, ["low", "high"])
    sides = []
    # a piece has a row at least, so the last `back` rows before a piece stand in the `back` pieces before it
    for side, n, fits, others in ((-1, back, F.col("scan_place") > F.col("high") - back, pieces.rowsBetween(-back, -1)), (1, ahead, F.col("scan_place") < F.col("low") + ahead, pieces.rowsBetween(1, ahead))):
        if n:
            kept = near.where(fits).groupBy("scan_piece", *by).agg(F.sort_array(F.collect_list(F.struct("scan_place", whole.alias("row")))).alias("rows"))
            around = kept.select("scan_piece", *by, F.flatten(F.collect_list("rows").over(others)).alias("rows"))
            around = around.withColumn("rows", F.slice("rows", F.greatest(F.size("rows") - n + 1, F.lit(1)), n) if side < 0 else F.slice("rows", 1, n))
            own = around.select(F.col("scan_piece").alias("for_piece"), F.posexplode("rows").alias("at", "one"))
            sides.append(own.select("one.row.*", "for_piece", "at").drop("scan_piece", "scan_place").withColumnsRenamed({"for_piece": "scan_piece", "at": "scan_place"}).withColumn("scan_side", F.lit(side)))
    halo = functools.reduce(lambda a, b: a.unionByName(b), sides).withColumn("scan_place", F.col("scan_place").cast("bigint"))
    return carried, written(halo, "scan-halo")


def _of(rows: DataFrame, groups: DataFrame, by: list[str], more: list[str]) -> DataFrame:
    """The rows of these pieces' groups, with further columns of the groups, which are a few for each piece."""
    same = functools.reduce(lambda a, c: a & rows[c].eqNullSafe(groups[c]), by, rows["scan_piece"] == groups["scan_piece"])
    return rows.join(F.broadcast(groups), same).select(*[rows[c] for c in rows.columns], *[groups[c] for c in more])
