"""Mixing sources to target weights, in DataFrame functions only.

Each source's tokens are summed, the total is shared out by weight, and each
document is emitted floor(rate) times plus once more with a probability equal
to the fraction of its source's rate. The coin is a hash of a seed, the
document's id and text, and the row's number among rows that are equal in id,
text and source, so that reruns agree and each row draws a coin of its own.

Nulls: a null text has size 0; a null source is a source of its own, ordered
last; a null id hashes as the empty string. Rows with one id, or none, have
coins by their texts, and equal rows by their numbers, which follow a hash of
the other columns. Texts are read whole, of any length. Sources that reach their
caps together settle in the order of their names. A source without words gets no
copies. An empty table gives an empty result. Columns of the input are kept; the
operator's own have the prefix `mix_`, and `with_copies` replaces clashing input
columns, `mixed` leaves them as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brookmill.llm.store import join_checked, passing, set_apart, written
from brookmill.operators.scans import ordered, row_number

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0) -> DataFrame:
    """One row per source of `sizes` (source, size): mix_source_size, mix_target.

    Sources in code point order, null last, take the weights in turn. They
    share the total by weight; no target exceeds max_repeat times its source's
    size, and what is cut off goes to the others by weight until none is above.

    The level at which the shares settle comes from one pass over the sources
    in the order in which they reach their caps. The windows run over one row
    per source, never over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("mix_source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    capped = totals.select("source", "mix_source_size", turn.alias("w")).withColumn("cap", F.col("mix_source_size") * F.lit(float(max_repeat)))
    filling = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy(F.lit(1))
    left = F.sum(F.col("mix_source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = capped.withColumn("level", left / open_weight).withColumn("place", F.row_number().over(filling))
    first_open = F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    target = F.least("cap", F.col("w") * first_open["level"])
    return levels.select("source", "mix_source_size", target.alias("mix_target"))


def coin(doc_id: Column, text: Column, number: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed, id, the text's MD5 and number."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit("")), number.cast("string")]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def told_apart(docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs with mix_number: a row's number, from 1, among rows with the same id, text and source.

    `again` is a written table with the mix_row of all rows that repeat (and of
    any others). These alone are sorted, into even pieces, so that rows that are
    equal in all columns may be many.
    """
    if not again.limit(1).count():
        return docs.withColumn("mix_number", F.lit(1))
    known = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    key = F.md5(F.concat_ws(":", known(F.col("doc_id").cast("string")), known(F.md5("text")), known(F.col("source"))))
    hashed = [f"`{f.name}`" for f in docs.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    repeated = join_checked(docs, again, ["mix_row"], "left_semi").select(
        key.alias("mix_key"), F.xxhash64(*hashed).alias("mix_order"), F.monotonically_increasing_id().alias("mix_place"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("mix_whole"))
    repeated = ordered(repeated, ["mix_key"], ["mix_order", "mix_place"], {"mix_number": row_number()}).select("mix_whole.*", "mix_number")
    return join_checked(docs, again, ["mix_row"], "left_anti").withColumn("mix_number", F.lit(1)).unionByName(repeated)


def with_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0, seed: str = "mix") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies, one row per input row."""
    docs = docs.drop("mix_source_size", "mix_target", "mix_copies", "mix_number").withColumn("mix_row", F.xxhash64("doc_id", "text", "source"))
    with passing() as tables:
        rows = written(docs.groupBy("source", "mix_row").agg(F.count("*").alias("n"), F.sum(n_words(F.col("text"))).alias("size")), "mix-rows")
        targets = written(source_targets(rows.select("source", "size"), weights, max_repeat), "mix-targets")
        again = written(rows.where("n > 1").select("mix_row").distinct(), "mix-again")
        tables.keep(targets, again)
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    joined = join_checked(
        told_apart(docs, again).withColumns({"mix_size": n_words(F.col("text")), "mix_key": key(F.col("source"))}),
        targets.select(key(F.col("source")).alias("mix_key"), "mix_source_size", "mix_target"),
        ["mix_key"], "left",
    )
    rate = F.least(F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0), F.lit(float(max_repeat)))
    extra = (coin(F.col("doc_id"), F.col("text"), F.col("mix_number"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("mix_copies", F.floor(rate).cast("long") + extra).drop("mix_key", "mix_row", "mix_number")


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    docs, back = set_apart(docs, ("doc_id", "text", "source"))
    taken = with_copies(docs, weights, max_repeat, seed).where(F.col("mix_copies") > 0)
    return back(taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))))
