"""Importance resampling towards a target's distribution, over an integer dictionary of words.

Distinct words of documents and target get integer ids, n-grams are tuples of
ids. A word's id is 63 bits of its hash, so that a task finds it without a
lookup; should words share one, all but the first get ids of their own above.
Each distinct tuple is counted, its words are put together again from the
dictionary and their bytes hashed once; the hash's bucket gains
floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets)))) where s
of S n-grams of documents and t of T of the target fall into it. The gains are
joined back to the tuples of each document, whose sum is the document's weight.
Gumbel noise, a hash of seed and id, makes the highest scores a draw without
replacement in proportion to the weights.

Frequent tuples are looked up in a table of at most FREQUENT_BYTES, sent to all
tasks; rarer ones, which no key is hot among, are joined by a shuffle. So most
of a text meets no shuffle, and the dictionary may be of any size. Ranks come
from even pieces in order of score.

Words: A-Z are lower-cased, then what lies between the other ASCII characters
than digits and letters. A null text has no words, weight 0; below
`least_words` words a row isn't drawn. A null id draws the noise of the empty
string and comes last among ties; equal rows are drawn one by one. Texts of any
length are read whole. Without a target all gains follow from s alone. An empty
table gives an empty result. Columns of the input are kept; the operator's own
have the prefix `imp_` and clash with none, as `resampled` sets others apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.llm.store import passing, set_apart, written
from brookmill.operators.scans import numbered

#: Most bytes, as Python holds them, of the frequent tuples that go to every task, and what one takes besides 8 for each id.
FREQUENT_BYTES, TUPLE_BYTES = 48_000_000, 180
#: Words, and rare tuples, to a batch that leaves Python; different words or tuples that a task holds at a time.
BATCH_WORDS, HELD = 1_000_000, 300_000
#: Bits of a word's id that come from its hash. Ids above are those of words whose hash is another's as well.
BITS = 63
#: Bytes of a word lower-cased, all others as a space.
BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Ids(dict):
    """The ids of words, as 8 bytes each, remembered while there is room."""

    def __init__(self, odd: dict[bytes, bytes], bits: int) -> None:
        super().__init__()
        self.odd, self.mask = odd, (1 << bits) - 1

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= HELD:
            self.clear()
        found = self.odd.get(word) or (xxhash.xxh64_intdigest(word) & self.mask).to_bytes(8, "big")
        self[word] = found
        return found


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(BYTES).split()


def tuples_of(ids: list[bytes], n: int) -> list[bytes]:
    """The runs of n ids, as 8 * n bytes each."""
    return ids if n == 1 else [b"".join(ids[i : i + n]) for i in range(len(ids) - n + 1)]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py()


def _counts(texts: DataFrame, longest: int, odd: dict[bytes, bytes], bits: int) -> DataFrame:
    """A written table tuple, word, s, t: how often each tuple stands in texts (text, ours) that are ours, and in others. word is null but for single words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(odd, bits)

        def rows(single, longer, ours):
            keys = [ids[w] for w in single] + list(longer)
            words = pa.concat_arrays([pa.array(list(single), pa.binary()).cast(pa.string()), pa.nulls(len(longer), pa.string())])
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), words, pa.array([ours] * len(keys), pa.bool_()), pa.array([*single.values(), *longer.values()], pa.int64())], names=["tuple", "word", "ours", "n"])

        found: dict[bool, tuple[Counter, Counter]] = {True: (Counter(), Counter()), False: (Counter(), Counter())}
        for batch in batches:
            for text, ours in zip(_texts(batch), batch.column("ours").to_pylist()):
                words, (single, longer) = words_of(text), found[ours]
                single.update(words)
                if longest > 1:
                    each = list(map(ids.__getitem__, words))
                    for n in range(2, longest + 1):
                        longer.update(tuples_of(each, n))
                if len(single) + len(longer) >= HELD:
                    yield rows(single, longer, ours)
                    found[ours] = Counter(), Counter()
        for ours, (single, longer) in found.items():
            yield rows(single, longer, ours)

    rows = texts.select("text", "ours").mapInArrow(count, "tuple binary, word string, ours boolean, n bigint")
    of = lambda ours: F.sum(F.when(F.col("ours") == ours, F.col("n")).otherwise(0))
    return written(rows.groupBy("tuple", "word").agg(of(True).alias("s"), of(False).alias("t")), "imp-counts")


def counted(docs: DataFrame, target: DataFrame, longest: int, bits: int = BITS) -> tuple[DataFrame, dict[bytes, bytes]]:
    """The counts of all tuples, and the ids of words that share a hash with a lesser one; such words are a handful in billions."""
    texts = docs.select("text", F.lit(True).alias("ours")).unionByName(target.select("text", F.lit(False).alias("ours")))
    table = _counts(texts, longest, {}, bits)
    shared = table.where(F.col("word").isNotNull()).groupBy("tuple").agg(F.count("*").alias("n"), F.collect_list("word").alias("words")).where("n > 1")
    again = sorted(w for r in shared.select("words").collect() for w in sorted(r["words"], key=str.encode)[1:])
    odd = {w.encode(): ((1 << 63) + k).to_bytes(8, "big") for k, w in enumerate(again)}
    return (_counts(texts, longest, odd, bits) if odd else table), odd


def gained(table: DataFrame, longest: int, buckets: int) -> DataFrame:
    """A written table tuple, s, gain of the tuples that stand in documents."""
    words = table.where(F.col("word").isNotNull())
    hashed = lambda text: F.crc32(text.cast("binary")) % F.lit(buckets)
    tuples = words.select("tuple", "s", "t", hashed(F.col("word")).alias("bucket"))
    if longest > 1:
        longer = table.where(F.col("word").isNull()).select("tuple", "s", "t")
        places = F.sequence(F.lit(0), (F.octet_length("tuple") / 8).cast("int") - 1)
        each = longer.select("tuple", F.posexplode(F.transform(places, lambda k: F.substr("tuple", k * 8 + 1, F.lit(8)))).alias("at", "id"))
        each = each.join(words.select(F.col("tuple").alias("id"), "word"), "id").groupBy("tuple").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
        text = F.array_join(F.transform("words", lambda x: x["word"]), " ")
        tuples = tuples.unionByName(longer.join(each.select("tuple", hashed(text).alias("bucket")), "tuple"))
    tuples = written(tuples, "imp-tuples")
    sums = written(tuples.groupBy("bucket").agg(F.sum("s").alias("bucket_s"), F.sum("t").alias("bucket_t")), "imp-buckets")  # as many rows as buckets at most
    totals = sums.agg(F.coalesce(F.sum("bucket_s"), F.lit(0)).alias("s"), F.coalesce(F.sum("bucket_t"), F.lit(0)).alias("t")).first()
    share = (F.col("bucket_t") + 1) * F.lit(float(totals["s"] + buckets)) / ((F.col("bucket_s") + 1) * F.lit(float(totals["t"] + buckets)))
    gains = F.broadcast(sums.select("bucket", F.floor(1000 * F.log(share)).alias("gain")))
    return written(tuples.where("s > 0").join(gains, "bucket").select("tuple", "s", "gain"), "imp-gains")


def frequent(gains: DataFrame, most_bytes: int) -> Column:
    """Which tuples of gains are frequent: those of the highest counts that take most_bytes together, but for those of about the least of these counts."""
    level, size = F.floor(4 * F.log2("s")).cast("int"), F.octet_length("tuple") + F.lit(TUPLE_BYTES)
    total, least = 0, None
    # a row for each quarter of a power of two
    for r in gains.groupBy(level.alias("level")).agg(F.sum(size).alias("bytes")).orderBy(F.desc("level")).collect():
        total += r["bytes"]
        if total > most_bytes:
            break
        least = r["level"]
    return F.lit(False) if least is None else level >= least


def weighed(docs: DataFrame, gains: DataFrame, longest: int, odd: dict[bytes, bytes], bits: int, carry: list[str], most_bytes: int) -> DataFrame:
    """The columns to carry of docs (with text), imp_row (a number of the row's own), imp_words, imp_features, imp_weight."""
    often = frequent(gains, most_bytes)
    known = gains.where(often).select("tuple", "gain").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(known.column("tuple").to_pylist(), known.column("gain").to_pylist())))
    names = ["imp_words", "imp_features", "imp_known", "imp_rare"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, gain_of = Ids(odd, bits), sent.value.get
        for batch in batches:
            start, size, rows = 0, 0, []

            def part(end):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())))]
                return pa.RecordBatch.from_arrays([batch.column(c).slice(start, end - start) for c in carry] + columns, names=[*carry, *names])

            for k, text in enumerate(_texts(batch)):
                each = list(map(ids.__getitem__, words_of(text)))
                features, total, rare = 0, 0, []
                for n in range(1, longest + 1):
                    keys = tuples_of(each, n)
                    found = list(map(gain_of, keys))
                    features += len(keys)
                    if None in found:
                        rare += [key for key, gain in zip(keys, found) if gain is None]
                        found = [gain for gain in found if gain is not None]
                    total += sum(found)
                rows.append((len(each), features, total, rare))
                size += len(each) + 10 * len(rare)
                if size >= BATCH_WORDS:
                    yield part(k + 1)
                    start, size, rows = k + 1, 0, []
            if rows:
                yield part(batch.num_rows)

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    fields = f"{kinds}imp_words bigint, imp_features bigint, imp_known bigint, imp_rare array<binary>"
    rows = written(docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(weigh, fields).withColumn("imp_row", F.monotonically_increasing_id()), "imp-rows")
    rare = rows.select("imp_row", F.explode("imp_rare").alias("tuple")).join(gains.where(~often).select("tuple", "gain"), "tuple")
    rare = rare.groupBy("imp_row").agg(F.sum("gain").alias("imp_rest"))
    out = rows.drop("imp_rare").join(rare, "imp_row", "left")
    return out.withColumn("imp_weight", F.col("imp_known") + F.coalesce("imp_rest", F.lit(0).cast("bigint"))).drop("imp_known", "imp_rest")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from 32 bits of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share)))


def ranked(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024,
    carry: tuple[str, ...] = ("doc_id",), most_bytes: int = FREQUENT_BYTES, bits: int = BITS,
) -> DataFrame:
    """The columns to carry (doc_id among them) of docs (doc_id, text) with imp_words, imp_features, imp_weight, imp_score, imp_rank.

    imp_rank counts the floor(percent * N / 100) highest scores of the N rows
    with at least least_words words, ties to the smaller id; others have none.
    """
    with passing() as tables:
        table, odd = counted(docs, target, longest, bits)
        gains = gained(table, longest, buckets)
        scored = weighed(docs, gains, longest, odd, bits, list(carry), most_bytes)
        scored = written(scored.withColumn("imp_score", F.col("imp_weight") + noise(F.col("doc_id"), seed)), "imp-scores")
        fit = F.col("imp_words") >= least_words
        many = scored.where(fit).count() * percent // 100
        order = numbered(scored.where(fit), [F.desc("imp_score"), F.col("doc_id").asc_nulls_last(), F.col("imp_row")], "imp_place", label="imp-order")
        out = order.withColumn("imp_rank", F.when(F.col("imp_place") <= many, F.col("imp_place"))).drop("imp_place")
        out = written(out.unionByName(scored.where(~fit).withColumn("imp_rank", F.lit(None).cast("bigint"))).drop("imp_row"), "imp-ranks")
        tables.keep(out)
    return out


def resampled(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that are drawn, in no order; columns stay as they are."""
    docs, back = set_apart(docs, ("doc_id", "text"))
    return back(ranked(docs, target, carry=tuple(docs.columns), **parameters).where(F.col("imp_rank").isNotNull()))
