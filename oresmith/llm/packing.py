"""Packing of tokenised documents into fixed windows by minimum bin slack.

A document's ids are cut into whole windows and one remainder, so a piece's length is between
1 and the window. How the pieces fill windows depends only on how many pieces there are of each
length, a table of at most ``window`` rows however large the corpus is. On that table, a window
is seeded with the longest length left, and a subset-sum over the remaining multiset, kept as
one bitset per length, finds the sum that leaves the least padding; the counts behind it are
read back from the bitsets. The found mixture is used as often as the counts allow, so a few
hundred mixtures describe any number of windows. Pieces are then numbered within their length,
and the number says which window of which mixture a piece belongs to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oresmith.llm.common import rank_within, step_folder, stored

WINDOW = 1024
PER_SALT = 50_000  # pieces of one length that one task numbers
END_OF_TEXT = "<|endoftext|>"


# ---------------------------------------------------------------- mixtures of lengths


def padding(total: int, window: int) -> int:
    """Padding of a sequence of ``total`` ids: none at a power of two, else up to the window."""
    return 0 if total & (total - 1) == 0 else window - total


def least_padded(counts: dict[int, int], window: int) -> dict[int, int]:
    """How many pieces of each length to put in the next window.

    ``counts`` are the pieces left, by length. The longest length is in; among the sums that
    the others can reach with it, the one with the least padding is taken, the larger one of
    equals.
    """
    longest = max(counts)
    room = window - longest
    left = dict(counts)
    left[longest] -= 1
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in left if left[n] and n <= room), reverse=True):
        before, copies = reach, min(left[length], room // length)
        chunk = 1
        while copies:  # 1, 2, 4, ... copies at once reach every number of copies
            take = min(chunk, copies)
            reach |= (reach << (take * length)) & mask
            copies, chunk = copies - take, 2 * chunk
        steps.append((length, before))
        if reach >> room & 1:
            break
    sums = [s for s in range(room + 1) if reach >> s & 1]
    rest = min(sums, key=lambda s: (padding(longest + s, window), -s))
    chosen = {longest: 1}
    for length, before in reversed(steps):
        used = 0
        while not before >> rest & 1:  # the fewest copies that lead back to a sum reached before
            rest, used = rest - length, used + 1
        if used:
            chosen[length] = chosen.get(length, 0) + used
    return chosen


def mixtures(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a window, number of such windows) until no piece is left."""
    left = {n: c for n, c in counts.items() if c}
    found = []
    while left:
        mixture = least_padded(left, window)
        times = min(left[n] // k for n, k in mixture.items())
        found.append((mixture, times))
        for n, k in mixture.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return found


# ---------------------------------------------------------------- packing of a table


def pack(pieces: DataFrame, order: list[str], length: str = "length", window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (long) to rows that each have a length of 1 to ``window``.

    All other columns are kept, whatever their names but these two and ``salt``, ``rank``.
    ``order`` settles which of several equally long pieces comes first; rows equal in it may
    change places. Each sequence is filled without gaps from offset 0, and each row is in one.
    The rows are stored once; the driver sees one count per length. Equal tables are packed alike,
    but for rows equal in ``order``. An empty table stays empty.
    """
    spark = pieces.sparkSession
    kept = stored(pieces, step_folder(spark, "packing"), "pieces")
    counts = {r[length]: r["count"] for r in kept.groupBy(length).count().collect()}
    # As many salts as give each a bounded number of the most frequent length's pieces.
    salts = max(1, -(-max(counts.values(), default=0) // PER_SALT))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))

    keys: list[tuple[int, int]] = []
    values: list[tuple[int, int, int]] = []
    used: dict[int, int] = {}
    first = 0
    for mixture, times in mixtures(counts, window):
        offset = 0
        for n in sorted(mixture, reverse=True):
            keys.append((n, used.get(n, 0)))
            values.append((first, mixture[n], offset))
            used[n] = used.get(n, 0) + times * mixture[n]
            offset += n * mixture[n]
        first += times
    # Sorted by (length, first rank), so that the entry of a piece is found by bisection.
    by_key = sorted(range(len(keys)), key=keys.__getitem__)
    start = np.array([keys[i] for i in by_key], dtype=np.int64).reshape(-1, 2)
    place = np.array([values[i] for i in by_key], dtype=np.int64).reshape(-1, 3)

    @F.pandas_udf(T.StructType().add("sequence_id", "long").add("offset", "long"))
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        of_length = np.searchsorted(start[:, 0], n, "left"), np.searchsorted(start[:, 0], n, "right")
        entry = np.empty(len(n), dtype=np.int64)
        for value in np.unique(n):
            rows = n == value
            low, high = of_length[0][rows][0], of_length[1][rows][0]
            entry[rows] = low + np.searchsorted(start[low:high, 1], rank[rows], "right") - 1
        within = rank - start[entry, 1]
        sequence, copies, offset = place[entry].T
        return pd.DataFrame({"sequence_id": sequence + within // copies, "offset": offset + within % copies * n})

    ranked = rank_within(salted, length, "salt", order)
    packed = ranked.withColumn("placed", placed(F.col(length), F.col("rank")))
    return packed.select(*pieces.columns, "placed.sequence_id", "placed.offset")


# ---------------------------------------------------------------- pieces of documents


def _characters_to_bytes() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class DocumentTokens:
    """Ids of texts as the tokenizer file gives them.

    The usual byte-level BPE file (ids in order of the merges, nothing else done to the text)
    is also a rank table, which a faster encoder reads; it gives the same ids. Texts that hold
    a special token, and any other kind of file, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.fast = self._rank_encoder(parts)

    @cached_property
    def tokenizer(self):
        """Read only for texts that need it: the two encoders side by side take twice the memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _rank_encoder(self, parts: dict):
        import public_tokenizers
        import tiktoken

        model, split = parts["model"], parts["pre_tokenizer"] or {}
        plain = (
            model.get("type") == "BPE"
            and split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and not parts["normalizer"]
            and not model.get("ignore_merges")
        )
        if not plain:
            return None
        vocabulary, to_byte = model["vocab"], _characters_to_bytes()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merged = [vocabulary["".join(pair)] for pair in pairs]
        if merged != sorted(merged) or len(set(merged)) != len(merged):
            return None
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


@lru_cache(maxsize=2)
def document_tokens(path: str) -> DocumentTokens:
    """One tokenizer per worker process and file."""
    return DocumentTokens(path)


PIECE_COLUMNS = ("start", "length", "ids", "doc_tokens")


def token_pieces(
    docs: DataFrame, id_column: str, text_column: str, tokenizer_path: str, end_id: int = 0, window: int = WINDOW
) -> DataFrame:
    """Whole texts as pieces of at most ``window`` ids: id, start, length, ids, doc_tokens.

    A document is its text's ids and then ``end_id``; NULL counts as an empty text, so it is
    that one id. ``ids`` is binary, little-endian unsigned 32-bit integers. Repeated rows give
    repeated pieces. The tokenizer's path must exist on every executor.
    """
    id_type = docs.schema[id_column].dataType
    schema = T.StructType().add(id_column, id_type).add("start", "long").add("length", "integer")
    schema = schema.add("ids", "binary").add("doc_tokens", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = document_tokens(tokenizer_path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows, starts, lengths, pieces, totals = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(tokens.ids(text), np.array([end_id], dtype="<u4")).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(piece))
                        pieces.append(piece.tobytes())
                        totals.append(len(ids))
                columns = [
                    part.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int32()),
                    pa.array(pieces, pa.binary()),
                    pa.array(totals, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame, id_column: str, text_column: str, tokenizer_path: str, digest: Column | None = None
) -> DataFrame:
    """Pieces of all documents with their ids, ``sequence_id`` and ``offset``.

    With ``digest``, an expression over ``ids`` with an alias, that column takes the place of
    the ids before anything is stored or shuffled.
    """
    pieces = token_pieces(docs, id_column, text_column, tokenizer_path)
    if digest is not None:
        pieces = pieces.select("*", digest).drop("ids")
    return pack(pieces, [id_column, "start"])
