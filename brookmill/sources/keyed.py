"""Tables of rows with a key, cut by ranges of the key, into which changed rows are merged.

A table is a folder: `data` has a folder of files for each group of keys that
was ever written, `manifest` a small file for each version, which lists the
groups of that version in order of their keys. A merge writes the groups anew
that its keys fall into, then publishes the next version by one rename, which
fails where another writer was first. Until then readers see the version
before; what a failed merge wrote is not listed anywhere, and vacuum() removes it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.functions.columns import place_among
from brookmill.operators.scans import in_pieces
from brookmill.sources.written import passing, written

#: Rows to a group, about.
GROUP_ROWS = 2_000_000


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    where, files = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def manifest(spark: SparkSession, root: str) -> dict:
    """The latest version: its number, key, schema, merges that it holds, and groups (low: the least key that belongs there; path: none if empty; rows)."""
    versions = [v for v in _listed(spark, f"{root}/manifest") if v.endswith(".json")]
    if not versions:
        raise FileNotFoundError(f"no table in {root}")
    where, files = _files(spark, f"{root}/manifest/{versions[-1]}")
    stream = files.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, found: dict) -> None:
    """Write a version aside and rename it into its place, unless that is taken."""
    aside, files = _files(spark, f"{root}/manifest/.{uuid.uuid4().hex}")
    out = files.create(aside)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    place, _ = _files(spark, f"{root}/manifest/{found['version']:012d}.json")
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(aside, place, none)
    except Py4JJavaError as e:
        files.delete(aside, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise FileExistsError(f"version {found['version']} of {root} was published by another writer") from e
        raise


def _groups(rows: DataFrame, root: str, key: str, part: Column, group_rows: int) -> dict[int, list[dict]]:
    """Write rows by part and range of keys; for each part its groups, in order."""
    spark = rows.sparkSession
    folder = f"{root}/data/{uuid.uuid4().hex}"
    with passing():
        many = written(rows.withColumn("keyed_part", part), "keyed-rows")
        pieces = 1 + many.count() // group_rows
        placed = in_pieces(many, [F.col("keyed_part"), F.col(key)], pieces, "keyed-pieces")
        # a row for each group comes to the driver, as the manifest does; equal keys stay in one group
        low = placed.groupBy("keyed_part", key).agg(F.min("scan_piece").alias("keyed_group"))
        grouped = placed.join(low, ["keyed_part", key]).drop("scan_piece", "scan_place")
        grouped.write.partitionBy("keyed_part", "keyed_group").parquet(folder)
    if not _listed(spark, folder) or _listed(spark, folder) == ["_SUCCESS"]:
        return {}
    sums = spark.read.parquet(folder).groupBy("keyed_part", "keyed_group").agg(F.min(key).alias("low"), F.count("*").alias("rows")).orderBy("keyed_part", "keyed_group").collect()
    out: dict[int, list[dict]] = {}
    for r in sums:
        out.setdefault(r.keyed_part, []).append({"low": r.low, "path": f"{folder}/keyed_part={r.keyed_part}/keyed_group={r.keyed_group}", "rows": r.rows})
    return out


def create(df: DataFrame, root: str, key: str, group_rows: int = GROUP_ROWS) -> None:
    """A new table of df's rows, whose key is a whole number, not null and unique."""
    groups = _groups(df, root, key, F.lit(0), group_rows).get(0) or [{"low": None, "path": None, "rows": 0}]
    groups[0]["low"] = None
    _publish(df.sparkSession, root, {"version": 0, "key": key, "schema": df.schema.json(), "merges": [], "groups": groups})


def read(spark: SparkSession, root: str, version: dict | None = None) -> DataFrame:
    """The rows of the latest version, or of one that manifest() gave."""
    found = version or manifest(spark, root)
    schema = T.StructType.fromJson(json.loads(found["schema"]))
    paths = [g["path"] for g in found["groups"] if g["path"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(root: str, changes: DataFrame, name: str, deleted: str, group_rows: int = GROUP_ROWS) -> int:
    """Put changed rows into a table, and return how many groups were written anew.

    changes has the table's columns and a boolean column `deleted`: a row takes
    the place of that with its key or is added, or says that the key goes. Keys
    have to be unique in it; null keys are left out. `name` tells this merge
    from others: one that the table holds already changes nothing, so a merge
    can be run again after any failure. Groups that no key falls into are
    neither read nor written.
    """
    spark = changes.sparkSession
    now = manifest(spark, root)
    if name in now["merges"]:
        return 0
    key, groups = now["key"], now["groups"]
    bounds = F.array(*[F.lit(g["low"] - 1) for g in groups[1:]]).cast("array<bigint>")
    with passing():
        placed = written(changes.where(F.col(key).isNotNull()).withColumn("keyed_place", place_among(bounds, F.col(key).cast("bigint"), len(groups))), "keyed-changes")
        hit = sorted(r[0] for r in placed.select("keyed_place").distinct().collect())
        columns = [c for c in changes.columns if c != deleted]
        old = read(spark, root, now | {"groups": [groups[k] for k in hit]}).withColumn("keyed_place", place_among(bounds, F.col(key).cast("bigint"), len(groups)))
        kept = old.join(placed.select(key), key, "left_anti").select(*columns, "keyed_place")
        rows = kept.unionByName(placed.where(~F.coalesce(F.col(deleted), F.lit(False))).select(*columns, "keyed_place"))
        parts = _groups(rows, root, key, F.col("keyed_place"), group_rows) if hit else {}
    after = []
    for k, group in enumerate(groups):
        new = [group] if k not in hit else [{"low": r["low"], "path": r["path"], "rows": r["rows"]} for r in parts.get(k, [])] or [{"low": group["low"], "path": None, "rows": 0}]
        new[0] = new[0] | {"low": group["low"]}
        after += new
    _publish(spark, root, now | {"version": now["version"] + 1, "merges": [*now["merges"], name], "groups": after})
    return len(hit)


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove folders of data that the latest version does not list, and how many they were; nobody may be merging or reading an earlier version."""
    used = {g["path"].split("/data/")[1].split("/")[0] for g in manifest(spark, root)["groups"] if g["path"]}
    gone = [d for d in _listed(spark, f"{root}/data") if d not in used]
    for d in gone:
        where, files = _files(spark, f"{root}/data/{d}")
        files.delete(where, True)
    return len(gone)
