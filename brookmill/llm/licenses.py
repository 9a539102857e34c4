"""Search for license notices, exact or with a few errors.

A text is lower-cased (A-Z) and reduced to its words, runs of digits, letters
and characters beyond ASCII, with one space between. A notice of n characters
may have n // 7 errors, 3 at most. It is split into one piece more than it may
have errors, so that at least one piece stands unchanged in every match
(pigeonhole); an automaton finds all pieces of all notices in one pass over the
text. Around each place so found, the regex library looks for the whole notice
with a bounded number of errors, from a word's start to a word's end, and
reports the span and its errors. Every place where a notice stands without
errors is found, as all its pieces stand there. A match is `sure` if its notice has
35 characters or more, or if it has the notice's words, each with one error at
most (a swap of neighbours is one) and those of up to 4 letters, such as names
of licenses, with none: "bit license" and "general publicity license" are within
the errors of a notice, but no sure matches.

Of matches of one notice that begin at one place the one with the least errors
counts; different notices are reported apart, also where they overlap. Nulls: a
null text is an empty one without words. Texts of any length are searched
whole. Repeated rows are searched alike; an empty table gives an empty result.
Input columns stay; those that clash with the operator's own (prefix
`license_`) are replaced. Other notices can be given in place of those below.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The notices that must be found, with their labels.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Further notices, in the words of the licenses and of common file headers.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("creative commons attribution", "cc"),
    ("licensed under cc by", "cc"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("academic free license", "afl"),
    ("artistic license", "artistic"),
    ("bsd 2 clause license", "bsd"),
    ("bsd 3 clause license", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd"),
    ("boost software license", "bsl"),
    ("cecill free software license agreement", "cecill"),
    ("common development and distribution license", "cddl"),
    ("common public license", "cpl"),
    ("to the extent possible under law the author s have dedicated all copyright", "cc0"),
    ("european union public licence", "eupl"),
    ("either version 2 of the license or at your option any later version", "gpl"),
    ("gnu free documentation license", "gfdl"),
    ("microsoft public license", "mspl"),
    ("microsoft reciprocal license", "msrl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("open database license", "odbl"),
    ("open software license", "osl"),
    ("php license", "php"),
    ("postgresql license", "postgresql"),
    ("python software foundation license", "psf"),
    ("q public license", "qpl"),
    ("sil open font license", "ofl"),
    ("sleepycat license", "sleepycat"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib"),
    ("universal permissive license", "upl"),
    ("university of illinois ncsa open source license", "ncsa"),
    ("zope public license", "zpl"),
)
#: Characters from which on a notice within its errors is a notice.
LONG = 35
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: How far past its window a match is followed to the end of a word.
WORD_END = 64
#: Windows whose result a worker remembers.
REMEMBERED = 20_000
HIT = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("errors", T.IntegerType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("sure", T.BooleanType()),
])


def errors_allowed(phrase: str) -> int:
    return min(3, len(phrase) // 7)


def one_error(a: str, b: str) -> bool:
    """Whether a word is another but for one letter more, less or exchanged, or two neighbours swapped."""
    n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    ends = {a[n + 1 :] + "|" + b[n + 1 :], a[n + 1 :] + "|" + b[n:], a[n:] + "|" + b[n + 1 :]}
    swapped = len(a) == len(b) and a[n : n + 2] == b[n : n + 2][::-1] and a[n + 2 :] == b[n + 2 :]
    return a == b or swapped or any(x == y for x, _, y in (e.partition("|") for e in ends))


def word_by_word(phrase: str, text: str) -> bool:
    """Whether text has the words of a notice, the short ones unchanged, the others with one error at most."""
    words, there = phrase.split(), text.split()
    return len(words) == len(there) and all(w == t or (len(w) > 4 and one_error(w, t)) for w, t in zip(words, there))


def pieces(phrase: str) -> list[tuple[int, str]]:
    """errors + 1 parts of about equal length, each with its place."""
    n = errors_allowed(phrase) + 1
    cuts = [len(phrase) * k // n for k in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Finder:
    """The pieces' automaton and the notices' patterns."""

    def __init__(self, notices: Sequence[tuple[str, str]]):
        self.notices, self.automaton = notices, ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (phrase, _) in enumerate(notices):
            for at, piece in pieces(phrase):
                where.setdefault(piece, []).append((n, at))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?be)(?<![^ ])(?:{regex.escape(p, literal_spaces=True)}){{e<={errors_allowed(p)}}}(?![^ ])") for p, _ in notices]
        # the same lines come again and again, within a text and over texts
        self.looked = functools.lru_cache(maxsize=REMEMBERED)(self._look)

    def _look(self, n: int, window: str, left: int) -> tuple[int, int, int] | None:
        """Start, end and errors of the best match of notice n in a window, from place `left` on."""
        match = self.patterns[n].search(window, left)
        return (match.start(), match.end(), sum(match.fuzzy_counts)) if match else None

    def sure(self, n: int, text: str) -> bool:
        phrase = self.notices[n][0]
        return len(phrase) >= LONG or word_by_word(phrase, text)

    def hits(self, words: list[str]) -> list[tuple[str, str, int, int, int, str, bool]]:
        """label, phrase, errors, first and last word, text and sureness of each match, in order."""
        text = " ".join(words)
        starts: set[tuple[int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                starts.add((n, end - size + 1 - at))
        if not starts:
            return []
        word_start = np.cumsum([0, *[len(w) + 1 for w in words[:-1]]])
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for n, start in starts:
            phrase = self.notices[n][0]
            slack = errors_allowed(phrase)
            end = min(len(text), start + len(phrase) + slack)
            stop = text.find(" ", end, end + WORD_END)
            stop = stop if stop >= 0 else min(len(text), end + WORD_END)
            low = max(0, start - slack)
            left = min(low, 1)  # the character before tells whether a word starts there
            match = self.looked(n, text[low - left : stop], left)
            if match:
                (a, b), errors = (low - left + x for x in match[:2]), match[2]
                if (b == len(text) or text[b] == " ") and errors < found.get((n, a), (99, 0))[0]:
                    found[n, a] = errors, b
        out = []
        for (n, at), (errors, end) in sorted(found.items(), key=lambda x: (x[0][1], x[0][0])):
            first, last = np.searchsorted(word_start, [at, end - 1], side="right") - 1
            out.append((self.notices[n][1], self.notices[n][0], errors, int(first), int(last), text[at:end], self.sure(n, text[at:end])))
        return out


@functools.lru_cache(maxsize=4)
def finder(notices: tuple[tuple[str, str], ...]) -> Finder:
    return Finder(notices)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes: A-Z only


def scanned(docs: DataFrame, notices: tuple[tuple[str, str], ...] = BASE + NOTICES) -> DataFrame:
    """docs with license_words (how many) and license_hits (label, phrase, errors, first_word, last_word, text, sure)."""
    docs = docs.drop("license_words", "license_hits")
    schema = T.StructType([*docs.schema.fields, T.StructField("license_words", T.LongType()), T.StructField("license_hits", T.ArrayType(HIT))])
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("errors", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("text", pa.string()), ("sure", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = finder(notices)
        for batch in batches:
            counts, found = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py() or "")
                counts.append(len(words))
                found.append([dict(zip(HIT.names, h)) for h in search.hits(words)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(found, kind)], names=[*batch.schema.names, "license_words", "license_hits"])

    return docs.mapInArrow(scan, schema)
