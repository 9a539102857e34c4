"""Properties of the helpers that run inside tasks."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from brookmill.llm.licenses import BASE, NOTICES, finder, words_of
from brookmill.llm.minhash import plain_jaccard, probability_jaccard, shingle_set
from brookmill.llm.packing import pack
from brookmill.llm.sequences import best_fit_decreasing
from brookmill.llm.syncmers import anchors, edited, fingerprint, likeness
from brookmill.llm.textcode import code_points, shingle_codes, word_codes

weighted = st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1, max_size=20)
words = st.lists(st.sampled_from(["a", "b", "ab", "é", "日本", "x1", "."]), max_size=40).map(" ".join)


def arrays(d):
    keys = sorted(d)
    return np.array(keys, np.uint32), np.array([float(d[k]) for k in keys])


@given(weighted, weighted)
def test_probability_jaccard_is_its_definition(a, b):
    (x, p), (y, q) = arrays(a), arrays(b)
    want = sum(1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in a.keys() | b.keys()) for d in a.keys() & b.keys())
    assert abs(probability_jaccard(x, p, y, q) - want) < 1e-9
    assert abs(probability_jaccard(x, 3 * p, y, q) - want) < 1e-9
    assert abs(probability_jaccard(x, np.ones(len(x)), y, np.ones(len(y))) - plain_jaccard(x, y)) < 1e-9


@given(words)
def test_codes_follow_words(text):
    parts = text.split(" ") if text else []
    codes = word_codes(text)
    assert len(codes) == len(parts) and (codes[:, None] == codes[None, :]).tolist() == [[a == b for b in parts] for a in parts]
    assert len(shingle_codes(codes)) == (max(1, len(parts) - 4) if parts else 0)
    assert sum(shingle_set(text)[1]) == len(shingle_codes(codes))


@given(st.lists(st.integers(1, 50), max_size=80))
def test_packers_fill_whole_items_once(lengths):
    where, offset = pack(np.array(lengths, np.int64), 50)
    ours = best_fit_decreasing(lengths, 50)
    assert sorted(i for b in ours for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 50 for b in ours)
    assert len(set(where.tolist())) <= len(ours)
    for b in set(where.tolist()):
        at = 0
        for i in sorted(np.flatnonzero(where == b).tolist(), key=lambda i: offset[i]):
            assert offset[i] == at
            at += lengths[i]
        assert at <= 50


@settings(max_examples=60)
@given(st.text(alphabet="abcé日 ", max_size=400), st.text(alphabet="abcé日 ", max_size=400))
def test_fingerprints(a, b):
    f, g = fingerprint(a), fingerprint(b)
    assert likeness(f, f) == 1.0 and likeness(f, g) == likeness(g, f) and 0 <= likeness(f, g) <= 1
    place, _ = anchors(code_points(a))
    assert len(f) == 8 * len(place) and (np.diff(place) > 0).all()
    assert len(edited(a, b)) == len(a) - len(a) // 2 + min(len(a) // 2, len(b))


@settings(max_examples=60)
@given(st.lists(st.sampled_from(["mit", "license", "apache", "general", "public", "x", "licens"]), max_size=25), st.integers(0, 24))
def test_every_exact_notice_is_found(parts, at):
    for phrase, label in BASE:
        found = finder(BASE + NOTICES).hits(words_of(" ".join([*parts[:at], phrase, *parts[at:]])))
        assert (label, phrase, 0, min(at, len(parts))) in [h[:4] for h in found]
