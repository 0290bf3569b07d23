"""Byte-level BPE encoding and decoding as a reduction over a tree.

Encodings of byte strings form a monoid: the empty encoding is neutral, and two encodings are
joined by encoding a small window around their border again. A sequence of tokens is the
encoding of its bytes exactly when every two neighbours are: encoding the bytes of the two
gives the same two tokens. So a join takes the last tokens of the left side and the first of
the right side, encodes their bytes, and is finished on a side as soon as the window's outer
token and the untouched token beside it are such neighbours; else the window grows on that
side. Halves are encoded recursively and joined up the tree; decoding concatenates up the tree.

Text is first cut at the pattern's matches, each encoded by itself. Matches repeat, so each
worker keeps the ids of those it has met, up to a fixed number.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with the Unicode property White_Space, which ``\s`` means in the pattern.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LEAF = 6
_SCANNED = 64  # bytes up to which the pair to merge is found by a scan
_REMEMBERED_WINDOW = 16
_REMEMBERED = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BpeMonoid:
    """Encodings as lists of token byte strings, with ``join`` as their product."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._neighbours: dict[tuple[bytes, bytes], bool] = {}
        self._short: dict[bytes, list[bytes]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Encode a byte string directly: merge the pair of lowest rank, leftmost first."""
        if len(data) > _SCANNED:
            return self._merge_by_heap(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        pairs = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            known = [r for r in pairs if r is not None]
            if not known:
                return parts
            i = pairs.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1])

    def _merge_by_heap(self, data: bytes) -> list[bytes]:
        """``merge`` in a time that grows little more than the data: pairs wait in a heap."""
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        following, before = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        rank, end = self.ranks.get, len(data)
        waiting = [(r, i) for i in range(end - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(waiting)

        def push(i: int, j: int) -> None:
            r = rank(parts[i] + parts[j])
            if r is not None:
                heappush(waiting, (r, i))

        while waiting:
            r, i = heappop(waiting)
            j = following[i]
            # Entries of pairs that have changed since are left in the heap.
            if parts[i] is None or j == end or rank(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            following[i] = after = following[j]
            if after < end:
                before[after] = i
                push(i, after)
            if before[i] >= 0:
                push(before[i], i)
        return [part for part in parts if part is not None]

    def neighbours(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = (left, right)
        found = self._neighbours.get(key)
        if found is None:
            if len(self._neighbours) > _REMEMBERED // 2:
                self._neighbours.clear()
            found = self._neighbours[key] = self.merge(left + right) == [left, right]
        return found

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of ``left`` followed by those of ``right``."""
        if not left or not right:
            return left or right
        if self.neighbours(left[-1], right[0]):
            return left + right
        a, b = 1, 1
        while True:
            rest, tail = left[:-a], right[b:]
            window = self._short_merge(b"".join(left[-a:] + right[:b]))
            left_holds = not rest or self.neighbours(rest[-1], window[0])
            right_holds = not tail or self.neighbours(window[-1], tail[0])
            if left_holds and right_holds:
                return rest + window + tail
            # In a run of one letter the whole right side moves; few large steps meet its end.
            a = a if left_holds else min((2 if a < 64 else 8) * a, len(left))
            b = b if right_holds else min((2 if b < 64 else 8) * b, len(right))

    def _short_merge(self, data: bytes) -> list[bytes]:
        """``merge``, remembered for short data: leaves and windows repeat."""
        if len(data) > _REMEMBERED_WINDOW:
            return self.merge(data)
        found = self._short.get(data)
        if found is None:
            if len(self._short) > _REMEMBERED // 2:
                self._short.clear()
            found = self._short[data] = self.merge(data)
        return found

    def encode(self, data: bytes) -> list[bytes]:
        """Two parts encoded and joined; leaves are merged directly.

        The left part is the largest power of two, so repeated letters and blocks give equal
        halves, of which one is encoded.
        """
        if len(data) <= _LEAF:
            return self._short_merge(data)
        middle = 1 << (len(data) - 1).bit_length() - 1
        left, right = data[:middle], data[middle:]
        encoded = self.encode(left)
        return self.join(encoded, encoded if left == right else self.encode(right))


class _Remembering(dict):
    """Results by key; asks ``make`` for those it does not have, and starts anew when full."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self._make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[key] = self._make(key)
        return value


class TextEncoder:
    """Text to ids as packed little-endian unsigned 32-bit integers, and back to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.monoid = BpeMonoid(ranks)
        self._packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self._bytes = {rank.to_bytes(4, "little"): token for token, rank in ranks.items()}
        own = pattern.replace(r"[^\s", "[^" + WHITE_SPACE).replace(r"\s", f"[{WHITE_SPACE}]")
        own = own.replace(r"\S", f"[^{WHITE_SPACE}]")
        self._matches = regex.compile(own).findall
        self._match_ids = _Remembering(self._encode_match)

    def _encode_match(self, match: str) -> bytes:
        data = match.encode("utf-8", "replace")
        whole = self._packed.get(data)
        return whole or b"".join([self._packed[token] for token in self.monoid.encode(data)])

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text; a missing text counts as an empty one."""
        if not text:
            return b""
        ids = self._match_ids
        return b"".join([ids[m] if len(m) < 64 else self._encode_match(m) for m in self._matches(text)])

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that packed ids stand for: both halves decoded, then concatenated."""
        ids = ids or b""
        if len(ids) <= 16384:
            tokens = self._bytes
            return b"".join([tokens[ids[i : i + 4]] for i in range(0, len(ids), 4)])
        middle = len(ids) // 8 * 4
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=2)
def text_encoder(ranks_path: str, pattern: str) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    return TextEncoder(read_ranks(ranks_path), pattern)


def encode(text: str | Column, ranks_path: str, pattern: str) -> Column:
    """Ids of each whole text as binary: little-endian unsigned 32-bit integers.

    NULL counts as an empty text, whose encoding is empty. The vocabulary file is read once by
    each Python worker, so its path must exist on every executor.
    """

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        encoder = text_encoder(ranks_path, pattern)
        return pd.Series([encoder.encode(t) for t in texts], dtype=object)

    return ids(text)


def decode(ids: str | Column, ranks_path: str, pattern: str) -> Column:
    """The bytes that packed ids stand for; NULL counts as no ids."""

    @F.pandas_udf("binary")
    def decoded(packed: pd.Series) -> pd.Series:
        encoder = text_encoder(ranks_path, pattern)
        return pd.Series([encoder.decode(p) for p in packed], dtype=object)

    return decoded(ids)


def round_trip(text: str | Column, ranks_path: str, pattern: str) -> Column:
    """struct(ids, decoded): ``encode`` and ``decode`` of its ids in one pass through Python.

    Two calls side by side would have the text encoded twice, once for each result.
    """

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: pd.Series) -> pd.DataFrame:
        encoder = text_encoder(ranks_path, pattern)
        ids = [encoder.encode(t) for t in texts]
        return pd.DataFrame({"ids": ids, "decoded": [encoder.decode(i) for i in ids]}, dtype=object)

    return both(text)


def unpack(ids: str | Column) -> Column:
    """Packed ids as an array of integers."""

    @F.pandas_udf("array<int>")
    def unpacked(packed: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([np.frombuffer(p or b"", dtype="<u4").astype("int32") for p in packed], dtype=object)

    return unpacked(ids)


def n_tokens(ids: str | Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
