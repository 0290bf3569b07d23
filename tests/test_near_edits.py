"""Near duplicates by edit ratio against comparing every two texts."""

import random
from fractions import Fraction

import pytest

from oresmith.operators import near_edits as module
from oresmith.operators.near_edits import least_length, near_edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, start=1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def brute(rows, share):
    found = set()
    for i, (later, b) in enumerate(rows):
        for earlier, a in rows:
            n = max(len(a or ""), len(b or ""))
            if earlier < later and distance(a or "", b or "") <= (1 - share) * n:
                found.add(later)
    return sorted(found)


def edited(choose, text, edits):
    text = list(text)
    for _ in range(edits):
        at = choose.randrange(len(text) + 1)
        kind = choose.choice(["put", "cut", "swap"])
        text[at : at + (kind != "put")] = "" if kind == "cut" else [choose.choice("abcdé ")]
    return " ".join("".join(text).split())


def made(seed):
    """Families around the border of the share, of all lengths."""
    choose, rows = random.Random(seed), []
    for length in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 25, 40, 60):
        for _ in range(3):
            text = "".join(choose.choice("abcdé ") for _ in range(length)).strip() or "a"
            rows.append(" ".join(text.split()))
            rows += [edited(choose, text, choose.randint(0, max(1, length // 3))) for _ in range(3)]
    choose.shuffle(rows)
    return list(enumerate(rows)) + [(900, ""), (901, None), (902, "a"), (903, "a" * 50), (904, "a" * 45)]


@pytest.mark.parametrize("share", ["0.8", "0.9"])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_two(spark, seed, share):
    rows = made(seed)
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
    found = sorted(r.id for r in near_edits(frame, "id", "text", float(share)).collect())
    assert found == brute(rows, Fraction(share))


@pytest.mark.parametrize("share", ["0.8", "0.75", "0.9", "0.95"])
def test_least_length_keeps_a_gram(share):
    share = Fraction(share)
    start = least_length(share, 3)
    assert all(n - 2 - 3 * int((1 - share) * n) >= 1 for n in range(start, 500))
    assert start == 1 or start - 1 - 2 - 3 * int((1 - share) * (start - 1)) < 1


def test_a_family_needs_a_row_a_member(spark, monkeypatch):
    """Copies of one text with an edit each are settled by the earliest, not by each other."""
    compared = []
    close = module._close

    def counted(pairs, texts, share):
        compared.append(pairs.count())
        return close(pairs, texts, share)

    monkeypatch.setattr(module, "_close", counted)
    choose = random.Random(5)
    text = "".join(choose.choice("abcdefgh ") for _ in range(120))
    rows = [(i, edited(choose, text, 3)) for i in range(200)]
    found = near_edits(spark.createDataFrame(rows, "id long, text string"), "id", "text").count()
    assert found == 199
    assert compared[0] < 200 * 40 and compared[1] == 0


def test_other_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "abcdefghij", 3), (2, "abcdefghiX", 4)], "key long, text string, n int")
    assert [r.key for r in near_edits(frame, "key", "text").collect()] == [2]
    assert near_edits(frame.where("false"), "key", "text").count() == 0
    with pytest.raises(ValueError):
        near_edits(frame, "key", "text", 0.5)
