"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes, and that of its language's common
words, are compared with the language's own over the whole corpus, by
Jensen-Shannon distance (base 2, so 0 to 1). Each comparison has a guard: below
a minimum length it gives no verdict, and the document stays.

Common words of a language are those with at least `min_share` of its words, so
that there are at most 1 / min_share of them. The rest of the words form one
more bin of the histogram. Words are taken as they are written.

Nulls: a null text has no words and fails the base rule; null languages form a
language of their own. A language with fewer than `min_reference_words` words
gives no verdict. Repeated rows are judged alike, texts of any length are read
whole, an empty table gives an empty result. The operator's own columns have the prefix `rule_`; input columns with
that prefix, or `ref_`, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.llm.store import join_checked, passing, set_apart, written

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Character classes within words, each by a pattern; "letter" is the rest of words, "space" what lies between them.
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "stop": r"[.,;:!?'\"()\-]",
    "symbol": r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:!?'\"()\-]",
}
KINDS = [*CLASSES, "letter", "space"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeated_words(w: Column) -> Column:
    """How many of the words w lie in a 3-word window that the text has twice or more.

    Windows are told apart by 64-bit hashes. Where some are equal, they are
    sorted with their places, so that equal ones are neighbours: n log n for a
    text of n words.
    """

    def places(s):
        again = F.filter(s, lambda x, i: (x["w"] == F.get(s, i - 1)["w"]).eqNullSafe(True) | (x["w"] == F.get(s, i + 1)["w"]).eqNullSafe(True))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    hashes = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    placed = lambda v: F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    some = let(hashes, lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), let(placed(v), places)).otherwise(0))
    return F.when(F.size(w) >= 3, some).otherwise(0)


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def class_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(p)).cast("long") for k, p in CLASSES.items()}


def marks(most: int) -> Column:
    """A character for each common word."""
    return F.array(*[F.lit(chr(0x4E00 + k)) for k in range(most)])


def measured(docs: DataFrame, most: int) -> DataFrame:
    """docs, which have ref_common, with rule_words, rule_word_chars, rule_symbols, rule_dup_lines,
    rule_repeat_words, the counts of the character classes, and rule_found: a character for each
    common word in the text, in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    common = F.coalesce(F.col("ref_common"), F.array().cast("array<string>"))
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).cast("long").alias("repeated"),
        F.array_join(F.transform(w, lambda x: F.get(marks(most), F.array_position(common, x).cast("int") - 1)), "").alias("found"),
    ))
    out = docs.withColumns({f"rule_{k}": v for k, v in class_counts(text).items()} | {
        "rule_w": of_words, "rule_chars": F.char_length(text).cast("long"), "rule_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"), "rule_dup_lines": repeated_lines(text),
    })
    rest = F.col("rule_w")["chars"]
    for k in CLASSES:
        rest = rest - F.col(f"rule_{k}")
    return out.withColumns({
        "rule_words": F.col("rule_w")["n"], "rule_word_chars": F.col("rule_w")["chars"], "rule_repeat_words": F.col("rule_w")["repeated"],
        "rule_found": F.col("rule_w")["found"], "rule_letter": rest, "rule_space": F.col("rule_chars") - F.col("rule_w")["chars"],
    }).drop("rule_w")


def language_key(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("l"), lang), F.lit("n"))


def references(docs: DataFrame, min_share: float, min_reference_words: int) -> DataFrame:
    """One row per language with enough words: its class shares, common words and their shares.

    Words are counted by language, combined within each task before they
    shuffle; all else follows from these counts and the languages' characters.
    Common words are found by a share of all words, which needs no sorted window.
    """
    key = language_key(F.col("lang")).alias("rule_lang")
    words = docs.select(key, F.explode(words_of(F.col("text"))).alias("word"))
    counted = written(words.groupBy("rule_lang", "word").agg(F.count("*").alias("n")), "rule-counted")
    chars = docs.select(key, F.char_length("text").alias("chars")).groupBy("rule_lang").agg(F.sum("chars").alias("ref_chars"))
    classes = class_counts(F.col("word"))
    sums = counted.select("rule_lang", "n", F.char_length("word").alias("chars"), *[v.alias(k) for k, v in classes.items()])
    sums = sums.groupBy("rule_lang").agg(F.sum("n").alias("ref_words"), F.sum(F.col("n") * F.col("chars")).alias("ref_word_chars"), *[F.sum(F.col("n") * F.col(k)).alias(f"ref_{k}") for k in classes])
    shares = written(sums.where(F.col("ref_words") >= min_reference_words).join(chars, "rule_lang"), "rule-shares")
    common = (
        join_checked(counted, shares.select("rule_lang", "ref_words"), ["rule_lang"], "inner")
        .where(F.col("n") >= F.col("ref_words") * F.lit(min_share))
        .groupBy("rule_lang").agg(F.sort_array(F.collect_list(F.struct("word", (F.col("n") / F.col("ref_words")).alias("share")))).alias("common"))
    )
    common = written(common, "rule-words")
    within = [F.col(f"ref_{k}") for k in CLASSES]
    letter = F.col("ref_word_chars")
    for k in within:
        letter = letter - k
    return shares.join(common, "rule_lang", "left").select(
        "rule_lang",
        F.transform(F.array(*within, letter, F.col("ref_chars") - F.col("ref_word_chars")), lambda n: n / F.col("ref_chars")).alias("ref_classes"),
        F.coalesce(F.transform("common", lambda x: x["word"]), F.array().cast("array<string>")).alias("ref_common"),
        F.coalesce(F.transform("common", lambda x: x["share"]), F.array().cast("array<double>")).alias("ref_shares"),
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares of one length."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def word_shares(found: Column, n: Column, kinds: Column, most: int) -> Column:
    """Shares of each of `kinds` common words, and of all other words, among n words.

    What taking a word's character out of `found` shortens it by is the word's count.
    """

    def of(x):
        counts = F.transform(F.slice(marks(most), F.lit(1), x["kinds"]), lambda c: F.char_length(x["found"]) - F.char_length(F.replace(x["found"], c, F.lit(""))))
        return F.transform(F.concat(counts, F.array(x["n"] - F.char_length(x["found"]))), lambda c: c / x["n"])

    return let(F.struct(found.alias("found"), n.cast("int").alias("n"), kinds.alias("kinds")), of)


def judged(
    docs: DataFrame, min_words: int = 50, most_repeated: int = 50, min_share: float = 0.01, min_reference_words: int = 1000,
    min_chars: int = 200, most_class_divergence: float = 0.28, min_common_words: int = 100, most_word_divergence: float = 0.25,
) -> DataFrame:
    """docs with the rule_ columns: counts, rule_base_failed, rule_class_divergence, rule_word_divergence, rule_kept."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith(("rule_", "ref_"))])
    with passing() as tables:
        refs = written(references(docs, min_share, min_reference_words), "rule-references")
        tables.keep(refs)
    most = int(1 / min_share) + 1
    out = join_checked(docs.withColumn("rule_lang", language_key(F.col("lang"))), refs, ["rule_lang"], "left")
    out = measured(out, most)
    classes = F.array(*[F.col(f"rule_{k}") / F.col("rule_chars") for k in KINDS])
    ref_all = F.concat(F.col("ref_shares"), F.array(F.greatest(F.lit(1.0) - F.aggregate("ref_shares", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))
    shares = word_shares(F.col("rule_found"), F.col("rule_words"), F.size("ref_common"), most)
    out = out.withColumns({
        "rule_class_divergence": F.when((F.col("rule_chars") >= min_chars) & F.col("ref_classes").isNotNull(), divergence(classes, F.col("ref_classes"))),
        "rule_word_divergence": F.when((F.col("rule_words") >= min_common_words) & (F.size("ref_common") > 0), divergence(shares, ref_all)),
        "rule_base_failed": (F.col("rule_words") < min_words) | (100 * F.col("rule_repeat_words") > most_repeated * F.col("rule_words")),
    })
    fits = (F.coalesce("rule_class_divergence", F.lit(0.0)) <= most_class_divergence) & (F.coalesce("rule_word_divergence", F.lit(0.0)) <= most_word_divergence)
    return out.withColumn("rule_kept", ~F.col("rule_base_failed") & fits).drop("rule_lang", "rule_found", "ref_classes", "ref_common", "ref_shares")


def kept(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that all rules keep; columns stay as they are."""
    docs, back = set_apart(docs, ("doc_id", "text", "lang"))
    # the verdict is exploded, so that it is computed once: Spark would copy its whole expression into a filter
    verdict = judged(docs, **parameters).select(*docs.columns, F.explode(F.array("rule_kept")).alias("rule_verdict"))
    return back(verdict.where("rule_verdict"))
