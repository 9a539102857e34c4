"""Token ids of whole texts with public tokenizers, within tasks.

The word tokenizer's merges are applied by two libraries. For texts of Latin-1
characters, the usual case, its pieces (contractions, letters, single digits,
runs of other characters) are parted by one space each, which stands for the
word end in a byte-level table of its merges; that is several times as fast as
the tokenizer's own library, which takes all other texts.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
OTHERS = "".join(re.escape(chr(c)) for c in range(256) if not chr(c).isalnum() and not chr(c).isspace())
#: Pieces of a lower-case Latin-1 text besides its letters.
PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{OTHERS}]+|[0-9\xb2\xb3\xb9\xbc-\xbe]")
#: What is white space for Python alone, or no Latin-1.
UNUSUAL = re.compile("[\x1c-\x1fĀ-\U0010ffff]")
WORD_END = "</w>"
RUN = re.compile(r"\s\s")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, letters from U+0100 on for the other bytes in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(rest)}


def _merge_table(model: dict) -> tuple[dict[bytes, int], np.ndarray]:
    """Ranks of the merges of bytes, with a space for the word end, and the id of each rank."""
    letters = _bytes_of_letters()

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token.removesuffix(WORD_END)) + b" " * token.endswith(WORD_END)

    id_of = {raw(token): number for token, number in model["vocab"].items() if all(c in letters for c in token.removesuffix(WORD_END))}
    single = [bytes([b]) for b in range(256)]
    merges = (pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"])
    order = [*single, *[b + b" " for b in single], *[raw(a + b) for a, b in merges]]
    return {token: rank for rank, token in enumerate(order)}, np.array([id_of[token] for token in order], "<u4")


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str):
    """The tokenizer's own library, loaded where a text asks for it."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@functools.lru_cache(maxsize=4)
def word_ids(path: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of the word tokenizer, without special tokens."""
    import tiktoken

    path = path or public_tokenizers.path(WORD_FILE)
    with open(path) as f:
        ranks, id_of = _merge_table(json.load(f)["model"])
    merging = tiktoken.Encoding("word", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if UNUSUAL.search(text):
            return np.array(word_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4")
        words = PIECE.sub(r" \g<0> ", text.lower()).split()
        return id_of[np.array(merging.encode_ordinary(" ".join(words) + " "), np.int64)] if words else id_of[:0]

    return ids


@functools.lru_cache(maxsize=8)
def byte_encoding(path: str | None = None, pattern: str = public_tokenizers.PATTERN):
    import tiktoken

    with open(path or public_tokenizers.path(BYTE_FILE), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def byte_ids(path: str | None = None) -> Callable[[str], list[int]]:
    """Ids of the byte-level tokenizer; every text can be restored from them.

    The pattern's look-ahead matters for runs of white space only, and costs
    time: texts without such runs are split without it.
    """
    encoding = byte_encoding(path)
    simple = byte_encoding(path, public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""))
    return lambda text: (encoding if RUN.search(text) else simple).encode_ordinary(text)
