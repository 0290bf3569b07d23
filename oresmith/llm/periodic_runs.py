"""Runs: maximal periodic stretches of words, by a suffix automaton with link-cut access.

The suffix automaton of the words is built word by word. Its suffix links form a tree, in which
the way from a prefix's state to the root passes all suffixes of the prefix. For every word the
way of its prefix is accessed and coloured with the word's number, as the link-cut trees' access
does: each preferred path, that is each stretch of the way with one colour, has one last
occurrence. Before it takes the new colour, a stretch tells that the suffixes down to its deepest
state, of length L, ended at its colour p before, and end at i now. With d = i - p <= L these two
occurrences touch or overlap: a square of period d, and the words from i - d - L + 1 to i have
period d. No longer suffix occurs at p, so the stretch cannot begin earlier; and d is the least
period, since a smaller one would have given the suffixes a later occurrence. The same start and
period are met at every word until the run ends, which extends the square to the run.

Paths are kept on the heavy chains of the link tree: a chain's coloured stretches, deepest first, are a
stack of which an access takes off the top ones and puts one back. So an access costs
a logarithm of stretches on average, like a link-cut tree's.

Only words that a run can hold go through the automaton. A run of 12 words or more, at least two
periods long, has at least 6 consecutive words equal to those one period on. So all its words lie in
runs of 6 words that the text has twice, and runs of neighbouring such words, the islands, are
handled one by one; a run crosses no island's border. This is exact for ``min_length`` = 2 * GRAM;
hashes that collide only make islands larger.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LENGTH = 12
GRAM = 6


def words_of(text: str | None) -> list[bytes]:
    """What ASCII white space separates."""
    return (text or "").encode("utf-8", "replace").split()


# ---------------------------------------------------------------- automaton and access


def suffix_automaton(word_ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end): of every state its longest text and its suffix link, of every prefix
    its state. State 0 is the root, with link -1."""
    length, link, following = [0], [-1], [{}]
    ends, last = [], 0
    for word in word_ids:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        following.append({})
        p = last
        while p >= 0 and word not in following[p]:
            following[p][word] = state
            p = link[p]
        if p >= 0:
            q = following[p][word]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                following.append(dict(following[q]))
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = clone
                    p = link[p]
                link[q] = link[state] = clone
        ends.append(state)
        last = state
    return length, link, ends


def heavy_chains(length: list[int], link: list[int]) -> list[int]:
    """For every state the top of its heavy chain in the link tree."""
    states = len(length)
    # A link leads to a shorter text, so this order has parents first.
    order = np.argsort(np.asarray(length), kind="stable").tolist()
    size, heavy = [1] * states, [-1] * states
    for state in reversed(order):
        parent = link[state]
        if parent >= 0:
            size[parent] += size[state]
            if heavy[parent] < 0 or size[state] > size[heavy[parent]]:
                heavy[parent] = state
    top = list(range(states))
    for state in order:
        if heavy[state] >= 0:
            top[heavy[state]] = top[state]
    return top


def runs_of_ids(word_ids: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, ascending."""
    length, link, ends = suffix_automaton(word_ids)
    top = heavy_chains(length, link)
    # Per chain the coloured stretches from the deepest to the top: (length of its deepest state, colour).
    painted: dict[int, list[tuple[int, int]]] = {}
    last_word: dict[tuple[int, int], int] = {}
    for i, state in enumerate(ends):
        below = -1  # the colour that the way had last, on the chain before
        while state > 0:
            chain, here = top[state], length[state]
            stretches = painted.get(chain)
            met = -1
            if stretches is None:
                painted[chain] = [(here, i)]
            else:
                met = stretches[-1][1]
                while stretches:
                    deepest, colour = stretches[-1]
                    reach = deepest if deepest < here else here
                    # A stretch that goes on from the chain below has told its longest suffix there.
                    if i - colour <= reach and colour != below:
                        last_word[colour - reach + 1, i - colour] = i
                    if deepest <= here:
                        stretches.pop()
                    if deepest >= here:
                        break
                stretches.append((here, i))
            below = met
            state = link[chain]
    found = [(start, last - start + 1, period) for (start, period), last in last_word.items()]
    return sorted((s, n, p) for s, n, p in found if n >= max(min_length, 2 * p))


# ---------------------------------------------------------------- texts


def islands(word_ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that lie in a repeated run of ``GRAM`` words."""
    n = len(word_ids) - GRAM + 1
    if n < 2:
        return []
    grams = np.zeros(n, dtype=np.uint64)
    for at in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + word_ids[at : at + n]
        grams ^= grams >> np.uint64(29)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    edges = np.zeros(len(word_ids) + 1, dtype=np.int64)
    repeated = np.zeros(n, dtype=bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    starts = np.flatnonzero(repeated)
    edges[starts] += 1
    edges[starts + GRAM] -= 1
    inside = np.cumsum(edges[:-1]) > 0
    borders = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return list(zip(borders[::2].tolist(), borders[1::2].tolist()))


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``MIN_LENGTH`` words, ascending."""
    if len(words) < MIN_LENGTH:
        return []
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(word, len(numbers)) for word in words]
    if len(numbers) == len(words):
        return []
    found = []
    for start, end in islands(np.array(ids, dtype=np.uint64)):
        if end - start >= MIN_LENGTH:
            found += [(start + s, n, p) for s, n, p in runs_of_ids(ids[start:end])]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([word for word, stays in zip(words, kept.tolist()) if stays])


_RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")
_FOUND = T.StructType().add("n_words", "long").add("runs", T.ArrayType(_RUN)).add("collapsed", "string")


def _periodic(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        words = words_of(text)
        runs = find_runs(words)
        named = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        rows.append((len(words), named, collapsed(words, runs).decode()))
    return pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])


def periodic_runs(text: Column) -> Column:
    """struct(n_words, runs, collapsed) of a text's words, the parts between ASCII white space.

    ``runs`` (start, length, period, ascending) are all stretches of at least 12 words and two
    periods whose words equal those one period on, that no word beside them continues, each with
    its least period. ``collapsed`` is the text without the words that a run repeats, joined by one space. NULL,
    empty and blank texts have no words, no runs and an empty ``collapsed``.
    """
    return F.pandas_udf(_periodic, _FOUND)(text)
