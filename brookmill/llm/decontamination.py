"""Benchmark decontamination, in DataFrame functions only.

Words are what lies between the characters of SPACES after A-Z are lower-cased.
A window is `width` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window. Windows of the items form a set of 64-bit
hashes, broadcast where its rows take at most BROADCAST_BYTES and joined by a
shuffle beyond. The windows of every document are looked up in it (see
`occurrences`), and what is found is verified word by word before it counts. A
document's word inside a verified occurrence is hit.

`found` reports what was hit, `without_spans` removes hit words, with what
stands between neighbouring ones, and `without_documents` removes documents.

Null or empty texts, of documents or items, have no words and hit nothing; null
items ids take part as the empty string, null document ids like others. Items
of equal words are one class, so copies of an item cost nothing; equal rows of
documents are looked up together and reported each. Texts of any length are
read whole. Without items no document is contaminated; an empty table gives an
empty result. Columns of the input are kept by the two removals; where they
clash with the operator's own (prefix `leak_`) they come back unchanged.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.llm.store import BROADCAST_BYTES, join_checked, passing, set_apart, written
from brookmill.operators.joins import size_in_bytes

WIDTH = 10
#: What parts words, in a text whose A-Z are lower-cased, and in any text.
SPACES = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_SPACES = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SPACES), "")


def _windows(df: DataFrame, widths: list[int]) -> DataFrame:
    """df, which has leak_words, with a row for each window of one of these widths: leak_at (from 1), leak_width, leak_hash."""
    # a hash a word and then one a window: words are read once, however many windows hold them
    df = df.withColumn("leak_hashes", F.transform("leak_words", lambda w: F.xxhash64(w)))
    many = lambda wide: F.greatest(F.size("leak_words") - wide + 1, F.lit(0))
    of = lambda wide: F.transform(F.slice("leak_hashes", F.lit(1), many(wide)), lambda x, i: F.xxhash64(F.slice("leak_hashes", i + 1, wide)))
    df = df.select("*", F.posexplode(F.array(*[of(w) for w in widths])).alias("leak_kind", "leak_every")).drop("leak_hashes")
    df = df.select("*", F.posexplode("leak_every").alias("leak_from", "leak_hash"))
    wide = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("leak_kind") + 1)
    return df.withColumns({"leak_at": F.col("leak_from") + 1, "leak_width": wide}).drop("leak_kind", "leak_every", "leak_from")


def item_windows(items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Written tables of the benchmark (item_id, text): the distinct windows (leak_hash, leak_width,
    leak_item_words) with their classes, and the items of each class (leak_class, leak_item)."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("leak_item"), words_of(F.col("text")).alias("leak_words")).where(F.size("leak_words") > 0)
    # equal words are one class; its name is a digest of them
    items = items.withColumn("leak_class", F.sha2(F.array_join("leak_words", " "), 256))
    members = written(items.select("leak_class", "leak_item").distinct(), "leak-items")
    texts = items.groupBy("leak_class").agg(F.first("leak_words").alias("leak_words"))
    # items of fewer words than the width are one window
    texts = texts.withColumn("leak_size", F.least(F.size("leak_words"), F.lit(width)))
    found = _windows(texts, list(range(1, width + 1))).where("leak_width = leak_size")
    found = found.select("leak_hash", "leak_width", F.slice("leak_words", F.col("leak_at"), F.col("leak_width")).alias("leak_item_words"), "leak_class")
    return written(found.distinct(), "leak-windows"), members


def seeds(windows: DataFrame) -> DataFrame:
    """leak_seed, leak_offset, leak_width: the hash of each window's longest word, which is rare as a rule, and the number of words before it."""
    longest = F.array_max(F.transform("leak_item_words", lambda w, i: F.struct(F.octet_length(w).alias("size"), (-i).alias("turn"), w.alias("word"))))
    chosen = windows.select("leak_width", longest.alias("x"))
    return chosen.select(F.xxhash64("x.word").alias("leak_seed"), (-F.col("x.turn")).alias("leak_offset"), "leak_width").distinct()


def occurrences(docs: DataFrame, windows: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verified occurrences in docs (leak_key, leak_words): leak_key, leak_at (from 1), leak_width, leak_class.

    Where the set of windows is broadcast, only those windows of documents are
    hashed and looked up that hold the longest word of one of the set in its
    place, as others can't be in it. Beyond most_bytes all are hashed, hashes
    alone are shuffled, and what is found goes back to the documents' words.
    """
    if size_in_bytes(windows) <= most_bytes:
        words = docs.select("*", F.posexplode("leak_words").alias("leak_place", "leak_word")).withColumn("leak_seed", F.xxhash64("leak_word"))
        held = words.join(F.broadcast(seeds(windows)), "leak_seed").withColumn("leak_at", F.col("leak_place") - F.col("leak_offset") + 1)
        held = held.where((F.col("leak_at") >= 1) & (F.col("leak_at") + F.col("leak_width") - 1 <= F.size("leak_words")))
        held = held.select("leak_key", "leak_at", "leak_width", F.slice("leak_words", F.greatest(F.col("leak_at"), F.lit(1)), F.col("leak_width")).alias("leak_doc_words"))
        # a hash of hashes, as the windows of the set have
        held = held.withColumn("leak_hash", F.xxhash64(F.transform("leak_doc_words", lambda w: F.xxhash64(w))))
        met = held.join(F.broadcast(windows), ["leak_hash", "leak_width"])
        return met.where(F.col("leak_doc_words") == F.col("leak_item_words")).select("leak_key", "leak_at", "leak_width", "leak_class")
    widths = [r.leak_width for r in windows.select("leak_width").distinct().orderBy("leak_width").collect()]  # as many as the width at most
    met = _windows(docs, widths).select("leak_key", "leak_at", "leak_width", "leak_hash").join(windows, ["leak_hash", "leak_width"])
    met = met.groupBy("leak_key").agg(F.collect_set(F.struct("leak_at", "leak_width", "leak_item_words", "leak_class")).alias("leak_met"))
    true = F.filter("leak_met", lambda m: F.slice("leak_words", m["leak_at"], m["leak_width"]) == m["leak_item_words"])
    return docs.join(met, "leak_key").select("leak_key", F.inline(true)).select("leak_key", "leak_at", "leak_width", "leak_class")


def _places(spans: Column) -> Column:
    """The distinct places (from 1) that spans (at, width) cover."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["width"] - 1))))


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows of one id and one text."""
    return F.sha2(F.concat(F.coalesce(F.concat(doc_id.cast("string"), F.lit(":")), F.lit("")), F.coalesce(text, F.lit(""))), 256)


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each distinct contaminated row of docs (doc_id, text): leak_key, leak_hits (places of
    hit words, from 1), leak_n_items, leak_items_sha256 (of the item ids, sorted as strings, joined by commas).

    A document's places are gathered from its own words only. The items of a
    document are gathered once for each distinct set of classes.
    """
    with passing() as tables:
        windows, members = item_windows(items, width)
        keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("leak_key"), words_of(F.col("text")).alias("leak_words"))
        met = occurrences(keyed, windows)
        of_row = met.groupBy("leak_key").agg(F.collect_set(F.struct(F.col("leak_at").alias("at"), F.col("leak_width").alias("width"))).alias("spans"), F.sort_array(F.collect_set("leak_class")).alias("classes"))
        rows = written(of_row.select("leak_key", F.sort_array(_places(F.col("spans"))).alias("leak_hits"), "classes", F.sha2(F.array_join("classes", ","), 256).alias("leak_set")), "leak-rows")
        sets = rows.groupBy("leak_set").agg(F.first("classes").alias("classes")).select("leak_set", F.explode("classes").alias("leak_class"))
        listed = sets.join(members, "leak_class").groupBy("leak_set").agg(F.sort_array(F.collect_set("leak_item")).alias("items"))
        listed = written(listed.select("leak_set", F.size("items").cast("bigint").alias("leak_n_items"), F.sha2(F.array_join("items", ","), 256).alias("leak_items_sha256")), "leak-sets")
        out = written(rows.join(listed, "leak_set").select("leak_key", "leak_hits", "leak_n_items", "leak_items_sha256"), "leak-hits")
        tables.keep(out)
    return out


def found(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text) with leak_n_words, leak_hits (null if none), leak_n_items and leak_items_sha256."""
    met = hits(docs, items, width)
    keyed = docs.select("*", row_key(F.col("doc_id"), F.col("text")).alias("leak_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_WORD)).cast("bigint").alias("leak_n_words"))
    out = join_checked(keyed, met, ["leak_key"], "left").drop("leak_key")
    return out.withColumns({"leak_n_items": F.coalesce("leak_n_items", F.lit(0).cast("bigint")), "leak_items_sha256": F.coalesce("leak_items_sha256", F.sha2(F.lit(""), 256))})


def without_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without a hit word; columns stay as they are."""
    docs, back = set_apart(docs, ("doc_id", "text"))
    return back(found(docs, items, width).where(F.col("leak_hits").isNull()))


def without_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with texts from which hit words are cut, each with what stands before it if the word before is cut as well."""
    docs, back = set_apart(docs, ("doc_id", "text"))
    met = found(docs, items, width)
    text = F.col("text")
    # what stands before each word, and after the last
    gaps = F.split(text, ANY_WORD)
    parts = F.transform(F.array_remove(F.split(text, ANY_SPACES), ""), lambda w, i: F.struct(w.alias("word"), F.get(gaps, i).alias("gap"), (i + 1).alias("at")))
    hit = lambda at: F.array_contains("leak_hits", at)
    kept = F.transform(parts, lambda p: F.when(~hit(p["at"]), F.concat(p["gap"], p["word"])).when(hit(p["at"] - 1), F.lit("")).otherwise(p["gap"]))
    cut = F.concat(F.array_join(kept, ""), F.element_at(gaps, -1))
    return back(met.withColumn("text", F.when(F.col("leak_hits").isNull(), text).otherwise(cut)))
