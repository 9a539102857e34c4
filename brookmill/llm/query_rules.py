"""op9: quality rules of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookmill.llm.rules import CLASSES, SYMBOL, WORD, judged
from brookmill.sources.tables import table


def op9_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return judged(docs).select(
        "doc_id",
        F.col("rule_words").alias("n_words"),
        F.col("rule_word_chars").alias("word_chars"),
        F.col("rule_symbols").alias("n_symbols"),
        F.col("rule_dup_lines").alias("n_dup_lines"),
        F.col("rule_repeat_words").alias("n_repeat_words"),
        F.col("rule_base_failed").alias("base_failed"),
        F.col("rule_kept").alias("kept"),
    )


def _count(value: str, pattern: str) -> str:
    return f"len(regexp_extract_all({value}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


_KINDS = [*CLASSES, "letter", "space"]
_PART = "CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END"

SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce('l' || lang, 'n') AS lang,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), counted AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(words) AS word FROM texts) GROUP BY ALL
), sums AS (
  SELECT lang, sum(n) AS ref_words, sum(n * length(word)) AS ref_word_chars, {", ".join(f"sum(n * {_count('word', p)}) AS ref_{k}" for k, p in CLASSES.items())}
  FROM counted GROUP BY lang HAVING sum(n) >= 1000
), shares AS (
  SELECT lang, ref_words, {", ".join(f"ref_{k} / ref_chars AS q_{k}" for k in CLASSES)},
         (ref_word_chars - {" - ".join(f"ref_{k}" for k in CLASSES)}) / ref_chars AS q_letter, (ref_chars - ref_word_chars) / ref_chars AS q_space
  FROM sums JOIN (SELECT lang, sum(length(text)) AS ref_chars FROM texts GROUP BY lang) USING (lang)
), common AS (
  SELECT lang, word, n / ref_words AS share FROM counted JOIN shares USING (lang) WHERE n >= ref_words * 0.01::DOUBLE
), measured AS (
  SELECT row, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) AS chars, {_count('text', SYMBOL)} AS n_symbols,
         {", ".join(f"{_count('text', p)} AS c_{k}" for k, p in CLASSES.items())},
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM texts
), windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, g) AS times
  FROM (SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM texts, unnest(range(1, len(words) - 1)) AS t(i))
), repeated AS (
  SELECT row, count(DISTINCT place) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE times > 1) GROUP BY row
), found AS (
  SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM texts) GROUP BY ALL
), pairs AS (
  SELECT m.row, coalesce(f.n, 0) AS n, n_words, c.share FROM measured m JOIN common c USING (lang) LEFT JOIN found f ON f.row = m.row AND f.word = c.word WHERE n_words >= 100
), word_parts AS (
  SELECT row, n / n_words AS p, share AS q FROM pairs
  UNION ALL SELECT row, (any_value(n_words) - sum(n)) / any_value(n_words), greatest(1 - sum(share), 0) FROM pairs GROUP BY row
), word_distance AS (
  SELECT row, sqrt(greatest(sum({_PART}) / 2, 0)) AS words_apart FROM word_parts GROUP BY row
), class_parts AS (
  SELECT row, unnest([{", ".join([*[f"c_{k}" for k in CLASSES], "word_chars - " + " - ".join(f"c_{k}" for k in CLASSES), "chars - word_chars"])}]) / chars AS p,
         unnest([{", ".join(f"q_{k}" for k in _KINDS)}]) AS q
  FROM measured JOIN shares USING (lang) WHERE chars >= 200
), class_distance AS (
  SELECT row, sqrt(greatest(sum({_PART}) / 2, 0)) AS classes_apart FROM class_parts GROUP BY row
), judged AS (
  SELECT *, coalesce(n_repeat_words, 0) AS repeats, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM measured LEFT JOIN repeated USING (row) LEFT JOIN word_distance USING (row) LEFT JOIN class_distance USING (row)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       repeats::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(classes_apart, 0) <= 0.28 AND coalesce(words_apart, 0) <= 0.25 AS kept
FROM judged"""
