"""Token ids of whole texts from a byte-level BPE vocabulary file.

The vocabulary is read from the tokenizer's JSON file and run by a BPE library that takes a
sixth of the time. Ids equal those of ``tokenizers`` with the file and
``add_special_tokens=False``: strings of the file's special tokens in a text become their ids.

Defined cases: an empty text has no ids; texts of any length and any run of one character are
taken whole. Runs of more than LONG_BLANKS blanks, at which the library's pattern matcher
would run out of stack, are cut off first at the places where the pattern itself cuts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed value: the pattern of the vocabulary's pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters of \s in that pattern.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANKS = 100_000
_RUN = re.compile(f"[{BLANK}]{{{LONG_BLANKS},}}")
_encoders: dict[str, Encoder] = {}


def byte_values() -> dict[str, int]:
    """The character that stands for each byte: itself if it is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in visible}
    return out | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if chr(x) not in out)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        added = vocabulary.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that take in their surroundings")
        byte, self._special = byte_values(), {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary["model"]["vocab"].items() if t not in self._special}
        self._bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if added else None
        self.size = max([*ranks.values(), *self._special.values()]) + 1

    def encode(self, text: str) -> bytes:
        """The ids, each as 4 bytes, little-endian."""
        if self._cut is None or not any(s in text for s in self._special):
            return self.encode_plain(text)
        parts = self._cut.split(text)  # texts and special tokens in turn
        return b"".join(array("I", [self._special[p]]).tobytes() if k % 2 else self.encode_plain(p) for k, p in enumerate(parts) if p)

    def encode_plain(self, text: str) -> bytes:
        """As encode(), but strings of special tokens are plain text."""
        if len(text) < LONG_BLANKS:
            return array("I", self._bpe.encode_ordinary(text)).tobytes()
        out, at = array("I"), 0
        for run in _RUN.finditer(text):
            # the pattern takes all of a run but its last blank, or all of it at the end of the text
            end = run.end() if run.end() == len(text) else run.end() - 1
            out.extend(self._bpe.encode_ordinary(text[at : run.start()]))
            out.extend(self._bpe._encode_single_piece(text[run.start() : end]))
            at = end
        out.extend(self._bpe.encode_ordinary(text[at:]))
        return out.tobytes()


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept for the life of the process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    """Start and ids of each piece: those of capacity many ids; only the first may be shorter."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    at = 0
    while at < n:
        end = first if not at else at + capacity
        yield at, ids[4 * at : 4 * end]
        at = end


def tokenized(column: pa.Array, path: str, end: int) -> Iterator[bytes]:
    """Ids of each text (null is empty) with the id ``end`` after it."""
    enc, last = encoder(path), np.array([end], dtype="<u4").tobytes()
    for text in column:
        yield enc.encode(text.as_py() or "") + last
