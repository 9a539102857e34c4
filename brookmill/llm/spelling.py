"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' values to the fifth power: anagrams have
one key, and adding, taking away or exchanging a letter adds a difference that
only depends on the letters. Keys that differ by one letter's value, or by an
exchange of two, become equal when that value is taken from one of them or from
both, so they are joined on these reduced keys: among distinct keys first, where
a reduced key meets at most one key for each letter. Only words whose keys have
met go on, each with the letter in question taken out at each of its places; they
are near if what is left is equal, letter by letter, and, for an exchange, the
place as well. Keys with equal sums by chance are told apart by that.

Near words are never listed pair by pair: words with equal rests are near to
each other, so counts and the most frequent ones of such groups are enough. A
group has a word for each letter at most, or for each letter and place beside the
word that lacks it.

Words have numbers in order of falling count, then of code points, so that the
preferred of two near words is the one with the lesser number. Forms point to
lesser numbers with counts at least doubled; chains are followed by pointer
doubling, in at most six rounds.

Letters are a-z and the 64 code points from U+00C0. Null words are left out. An
empty table gives an empty result. Words of any length are handled: for one of n
letters time grows with n squared, memory with n, and rests over 32 bytes are
compared by their MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brookmill.llm.store import join_checked, passing, written
from brookmill.operators.scans import numbered

#: Exponent of letter values.
POWER = 5


def letter_value(letter: Column) -> Column:
    """The value of a letter to the power: 1 to 26 for a-z, 27 to 90 for U+00C0 to U+00FF."""
    at = F.ascii(letter)
    return F.pow(F.when(at < 128, at - 96).otherwise(at - 192 + 27).cast("double"), F.lit(POWER)).cast("bigint")


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda total, c: total + letter_value(c))


def vocabulary(words: DataFrame, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """A written table of the distinct words of `words` (word): id (from 1, by falling count, then word), word, n, key."""
    counts = words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    with passing() as tables:
        keyed = numbered(counts, [F.desc("n"), F.col("word")], "id", label="spell-counts").withColumn("key", anagram_key(F.col("word")))
        out = written(keyed, "spell-words")
        tables.keep(out)
    return out


def met_keys(words: DataFrame) -> DataFrame:
    """key, letter (null: nothing is taken), less: the reductions of keys that two different keys have in common."""
    letters = words.select("key", F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    reduced = letters.select("key", "letter", (F.col("key") - letter_value(F.col("letter"))).alias("less"))
    whole = words.select("key").distinct().select("key", F.lit(None).cast("string").alias("letter"), F.col("key").alias("less"))
    every = reduced.unionByName(whole)
    met = every.groupBy("less").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("less")
    return every.join(met, "less", "left_semi")


def rests(words: DataFrame, met: DataFrame) -> DataFrame:
    """id, less, place, rest, whole: what words leave without a letter. place is -1 where letters are added or taken away;
    whole says that nothing was taken. Of equal neighbours one is taken, as the rests are equal, but for an exchange each."""
    rows = words.select("id", "word", "key").join(met, "key")
    whole = rows.where(F.col("letter").isNull()).select("id", "less", F.lit(-1).alias("place"), F.col("word").alias("rest"), F.lit(True).alias("whole"))
    places = F.filter(F.transform(F.split("word", ""), lambda c, i: F.struct(i.alias("at"), (c == F.col("letter")).alias("is"))), lambda p: p["is"])
    out = rows.where(F.col("letter").isNotNull()).select("id", "word", "less", "letter", F.explode(F.transform(places, lambda p: p["at"])).alias("at"))
    rest = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    first_of_run = (F.col("at") == 0) | (F.expr("substring(word, at, 1)") != F.col("letter"))
    kinds = F.explode(F.when(first_of_run, F.array(F.col("at"), F.lit(-1))).otherwise(F.array(F.col("at"))))
    taken = out.withColumn("rest", rest).select("id", "less", kinds.alias("place"), "rest", F.lit(False).alias("whole"))
    order = F.when(F.octet_length("rest") <= 32, F.col("rest")).otherwise(F.concat(F.lit("#"), F.md5("rest")))
    return whole.unionByName(taken).withColumn("rest", order)


def near(words: DataFrame) -> DataFrame:
    """id, n_near, best: how many words are near to each word that has some, and the least number among them."""
    group = W.partitionBy("less", "place", "rest")
    whole, other = F.when(F.col("whole"), F.col("id")), F.when(~F.col("whole"), F.col("id"))
    rows = rests(words, met_keys(words)).select(
        "*", F.count("*").over(group).alias("all"), F.min(whole).over(group).alias("base"), F.min(other).over(group).alias("first"))
    rows = rows.withColumn("second", F.min(F.when(~F.col("whole") & (F.col("id") != F.col("first")), F.col("id"))).over(group))
    added = F.col("place") == -1
    n = F.when(added & F.col("whole"), F.col("all") - 1).when(added, F.when(F.col("base").isNotNull(), 1).otherwise(0)).otherwise(F.col("all") - 1)
    best = F.when(added & F.col("whole"), F.col("first")).when(added, F.col("base")).when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return rows.select("id", n.alias("n"), best.alias("best")).where("n > 0").groupBy("id").agg(F.sum("n").cast("bigint").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """A written table id, up, where up is followed to the last; links has one row for each id that has a form."""
    now = written(links.select("id", "up"), "spell-links")
    while True:
        further = now.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        after = written(join_checked(now, further, ["up"], "left").select("id", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")), "spell-links")
        if after.where("moved").limit(1).count() == 0:
            return after.drop("moved")
        now = written(after.drop("moved"), "spell-links")


def variants(words: DataFrame) -> DataFrame:
    """A written table of the vocabulary `words`: word, n, n_near, form, form_n, root.

    form is the most frequent near word, if it is at least twice as frequent;
    root is the last form on the way from form to form, the word itself without one.
    """
    with passing() as tables:
        found = written(words.drop("key").join(near(words), "id", "left"), "spell-near")
        counts = words.select(F.col("id").alias("best"), F.col("n").alias("best_n"))
        formed = join_checked(found.where(F.col("best").isNotNull()), counts, ["best"], "inner").where(F.col("best_n") >= 2 * F.col("n"))
        formed = written(formed.select("id", F.col("best").alias("form_id"), F.col("best_n").alias("form_n")), "spell-forms")
        last = written(_rooted(formed), "spell-roots")
        named = lambda column, name: words.select(F.col("id").alias(column), F.col("word").alias(name))
        last = join_checked(join_checked(last, named("form_id", "form"), ["form_id"], "left"), named("root_id", "root"), ["root_id"], "left")
        out = join_checked(found, written(last.select("id", "form", "form_n", "root"), "spell-named"), ["id"], "left")
        out = out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
        out = written(out, "spell-variants")
        tables.keep(out)
    return out


def _rooted(formed: DataFrame) -> DataFrame:
    ends = roots(formed.select("id", F.col("form_id").alias("up"))).select("id", F.col("up").alias("root_id"))
    return formed.join(ends, "id")
