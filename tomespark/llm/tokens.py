"""Token counts of whole texts, with a vocabulary file of a public tokenizer.

A text is cut into stretches of non-blank characters with at most one leading
space, and into blank runs. The vocabulary's own pattern never joins characters
across such a cut, so the counts of the stretches add up to the count of the
text, and a memo of stretches saves most of the encoding.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken

#: Rank file of a byte-level BPE; every machine must have it at the same path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-token pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STRETCH = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_MEMO_ENTRIES = 400_000
_ID_MEMO_ENTRIES = 1_000_000
_MEMO_CHARS = 40
#: Longer texts are encoded in parts that end where a stretch ends.
PART_CHARS = 1 << 20
_BREAK = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


class Counter:
    """Counts tokens; keeps a bounded memo of short stretches."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, int] = {}

    def _fresh(self, stretch: str) -> int:
        n = len(self.encoding.encode_ordinary(stretch))
        if len(stretch) <= _MEMO_CHARS and len(self.memo) < _MEMO_ENTRIES:
            self.memo[stretch] = n
        return n

    def count(self, text: str | None) -> int:
        known, fresh, total = self.memo.get, self._fresh, 0
        for stretch in _STRETCH.findall(text or ""):
            n = known(stretch)
            total += fresh(stretch) if n is None else n
        return total


@cache
def counter(vocabulary: str = VOCABULARY) -> Counter:
    """One counter for each worker process."""
    return Counter(vocabulary)


def count_batch(texts: pa.Array, vocabulary: str) -> pa.Array:
    count = counter(vocabulary).count
    return pa.array([count(x.as_py()) for x in texts], pa.int64())


def parts(text: str) -> Iterator[str]:
    """A text in parts of about PART_CHARS, cut before a blank run only."""
    at = 0
    while len(text) - at > PART_CHARS and (found := _BREAK.search(text, at + PART_CHARS)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Encoder:
    """Ids of texts by a tokenizer file; keeps a bounded memo of short stretches.

    A text that holds one of the file's special tokens is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.memo: dict[str, bytes] = {}

    def _fresh(self, stretch: str) -> bytes:
        raw = np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()
        if len(stretch) <= _MEMO_CHARS and len(self.memo) < _ID_MEMO_ENTRIES:
            self.memo[stretch] = raw
        return raw

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(t in text for t in self.special):
            return self._fresh(text)
        known, fresh, out = self.memo.get, self._fresh, bytearray()
        for part in parts(text):
            out += b"".join([known(s) or fresh(s) for s in _STRETCH.findall(part)])
        return bytes(out)


@cache
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process; by default of the byte-level BPE with 50 000 merges."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(path)
