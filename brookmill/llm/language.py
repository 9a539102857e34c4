"""Language ID by hyperdimensional profiles.

Every letter of every script has a random vector of +1 and -1 of its own, made
from its code point. A letter trigram is the product of its letters' vectors,
each rotated by its place; a text is the sum of its trigrams' vectors, a
language the sum of its texts'. A text gets the language whose sum has the
greatest cosine with its own.

Letters are lower-cased. A trigram may begin or end at a word's edge, but does
not reach over it. Texts of any length are summed whole, in parts of bounded
length.

Languages are fitted on at most about `sample_rows` labelled rows each, taken
by a hash of the whole row. A null text, or one without a letter, is `und` with
score 0; so is every text if nothing was learned. Rows with a null language or
id are not learned from. More than MOST_LANGUAGES different values of lang are
an error, as one vector each comes to the driver. Repeated rows are judged
alike; ties go to the language first in order. An empty table gives an empty
result. Columns of the input are kept, clashing ones (`lang_pred`,
`lang_score`, `lang_judged`) replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.llm.textcode import code_points, seeded

DIMENSIONS = 1024
#: Trigram vectors that a worker keeps, and code points summed at a time.
KEPT, PART = 16_384, 1 << 20
#: A trigram is three code points in one number.
BASE = 0x110000
MOST_LANGUAGES = 2_000
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def lower_letters() -> np.ndarray:
    """For each code point 0 (no letter) or that of its letter in lower case."""
    letter = np.zeros(BASE, np.int32)
    for point in range(BASE):
        if (c := chr(point)).isalpha():
            letter[point] = ord(c.lower()) if len(c.lower()) == 1 else point
    return letter


def letter_vector(point: int) -> np.ndarray:
    """The vector of a letter; 0 is the edge of a word."""
    return 2 * (seeded(DIMENSIONS, 7 + point) >> np.uint64(63)).astype(np.float32) - 1


class Profiles:
    """Sums of trigram vectors; keeps letters' vectors, and those of the trigrams met first."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.grams, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)  # those kept, sorted, and where
        self.kept = np.empty((KEPT, DIMENSIONS), np.int8)

    def rotated(self, point: int) -> np.ndarray:
        """A letter's vectors for the three places."""
        if point not in self.letters:
            if len(self.letters) >= 4096:
                self.letters.clear()
            last = letter_vector(point)
            self.letters[point] = np.stack([np.roll(last, 2), np.roll(last, 1), last])
        return self.letters[point]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        points, number = np.unique(np.stack([grams // BASE**2, grams // BASE % BASE, grams % BASE]), return_inverse=True)
        table = np.stack([self.rotated(p) for p in points.tolist()])
        first, second, third = number.reshape(3, -1)
        return table[first, 0] * table[second, 1] * table[third, 2]

    def sum_of(self, text: str) -> tuple[np.ndarray, int]:
        """The text's sum of trigram vectors, and how many trigrams it has."""
        total, count = np.zeros(DIMENSIONS, np.float64), 0
        points = code_points(text)
        for at in range(0, len(points), PART):
            # one neighbour on each side; the ends of the text count as word edges
            part = lower_letters()[points[max(at - 1, 0) : at + PART + 1]].astype(np.int64)
            part = np.concatenate([np.zeros(int(at == 0), np.int64), part, np.zeros(int(at + PART >= len(points)), np.int64)])
            middle = part[1:-1]
            grams = ((part[:-2] * BASE + middle) * BASE + part[2:])[middle > 0]
            if len(grams):
                total += self._sum(*np.unique(grams, return_counts=True))
                count += len(grams)
        return total, count

    def _places(self, grams: np.ndarray) -> np.ndarray:
        """The kept row of each trigram, -1 for those not kept."""
        if not len(self.grams):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.row[at], -1)

    def _sum(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        row = self._places(grams)
        new = grams[row < 0][: KEPT - len(self.grams)]
        if len(new):
            used = len(self.grams)
            for at in range(0, len(new), 1024):
                self.kept[used + at : used + at + len(new[at : at + 1024])] = self.vectors(new[at : at + 1024])
            together, rows = np.concatenate([self.grams, new]), np.concatenate([self.row, np.arange(used, used + len(new))])
            order = np.argsort(together)
            self.grams, self.row = together[order], rows[order]
            row = self._places(grams)
        weight = counts.astype(np.float32)
        here, out = np.flatnonzero(row >= 0), np.zeros(DIMENSIONS, np.float64)
        for at in range(0, len(here), 1024):
            some = here[at : at + 1024]
            out += weight[some] @ self.kept[row[some]].astype(np.float32)
        rest, rest_weight = grams[row < 0], weight[row < 0]
        for at in range(0, len(rest), 1024):
            out += rest_weight[at : at + 1024] @ self.vectors(rest[at : at + 1024])
        return out


@functools.lru_cache(maxsize=1)
def profiles() -> Profiles:
    return Profiles()


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learned(docs: DataFrame, learn_from: Column, sample_rows: int = 20_000) -> dict[str, np.ndarray]:
    """The prototype of each language, a vector of fixed length.

    docs has doc_id, text and lang. Sums leave each task as one row a language
    and are added up by Spark; only the prototypes come to the driver.
    """
    rows = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} different values; is it a language's name?")
    shares = {r["lang"]: min(1.0, sample_rows / r["count"]) for r in counts}
    if not shares:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                total, count = profiles().sum_of(text.as_py())
                if count:
                    found[lang] = found.get(lang, 0) + total
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], names=["lang", "total"])

    parts = chosen.mapInArrow(sums, "lang string, total array<double>")
    added = parts.select("lang", F.posexplode("total").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in added.collect():
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["k"]] = r["x"]
    return dict(sorted(out.items()))


def identified(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and lang_score (the cosine, at least 0)."""
    names = list(prototypes)
    table = np.array([v / max(np.linalg.norm(v), 1e-12) for v in prototypes.values()]).reshape(len(names), DIMENSIONS)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found: list[tuple[str, float]] = []
            for text in texts:
                total, count = profiles().sum_of(text.as_py() or "")
                if not count or not names:
                    found.append((UNKNOWN, 0.0))
                    continue
                cosines = table @ total / max(np.linalg.norm(total), 1e-12)
                best = int(np.argmax(cosines))
                found.append((names[best], float(min(max(cosines[best], 0.0), 1.0))))
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "lang_score"])

    # only texts go to Python and only the prediction comes back; called nondeterministic, so that no filter repeats it
    judge = F.arrow_udf(predict, "struct<lang_pred: string, lang_score: double>").asNondeterministic()
    judged = docs.drop("lang_pred", "lang_score", "lang_judged").withColumn("lang_judged", judge("text"))
    return judged.select("*", "lang_judged.lang_pred", "lang_judged.lang_score").drop("lang_judged")
