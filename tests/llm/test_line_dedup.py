import random

import pytest

from oresmith.llm import line_dedup


def near(a, b):
    """Whether one insertion, deletion or replacement at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute(docs, min_chars=line_dedup.MIN_CHARS):
    """Text of every row without the lines that an earlier occurrence equals or is near to."""
    order = {}
    for i, (doc, text) in enumerate(docs):
        for number, line in enumerate((text or "").split("\n")):
            if len(line.strip(" ")) >= min_chars:
                order.setdefault((doc is None, doc or 0, number), []).append(line)
    places = sorted(order)

    def dropped(doc, number, line):
        here = (doc is None, doc or 0, number)
        return any(near(line, other) for place in places if place < here for other in order[place])

    result = []
    for doc, text in docs:
        if text is None:
            result.append((doc, None))
            continue
        lines = text.split("\n")
        kept = [line for n, line in enumerate(lines) if len(line.strip(" ")) < min_chars or not dropped(doc, n, line)]
        result.append((doc, "\n".join(kept)))
    return sorted(result, key=repr)


def random_docs(seed):
    choose, docs, lines = random.Random(seed), [], []
    for i in range(60):
        text = []
        for _ in range(choose.randint(0, 4)):
            if lines and choose.random() < 0.6:
                line = list(choose.choice(lines))
                for _ in range(choose.choice([0, 1, 1, 1, 2])):
                    at = choose.randrange(len(line)) if line else 0
                    edit = choose.choice(["put", "cut", "swap"])
                    line[at : at + (edit != "put")] = "" if edit == "cut" else [choose.choice("abé ")]
                line = "".join(line)
            else:
                line = "".join(choose.choice("abcdé fghij") for _ in range(choose.choice([3, 9, 10, 11, 17, 40])))
            lines.append(line)
            text.append(line)
        docs.append((i * 2, "\n".join(text)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = random_docs(seed) + [(500, None), (501, ""), (None, "a whole line alone"), (600, "a whole line alone")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    left = line_dedup.without_repeated_lines(frame, "doc_id", "text")
    assert sorted([(r["doc_id"], r["text"]) for r in left.collect()], key=repr) == brute(docs)


def test_many_lines_around_one_variant(spark):
    """A family of lines that all differ in one place is settled without pairing them."""
    docs = [(i, f"the line number {c} of a family") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")]
    docs.append((99, "the line number  of a family"))
    left = line_dedup.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    assert [r["doc_id"] for r in left.where("NOT emptied").collect()] == [0]


def test_odd_rows_keep_their_columns(spark, odd_docs):
    clashing = odd_docs.selectExpr("*", "'x' AS n_lines", "1 AS line", "2 AS h1", "3 AS row", "4 AS key", "5 AS numbers")
    left = line_dedup.without_repeated_lines(clashing, "doc_id", "text")
    assert left.columns == ["doc_id", "text", "lang", "score", "line", "h1", "row", "key", "numbers", "n_lines", "n_dropped", "emptied"]
    rows = left.collect()
    assert len(rows) == 8 and {r["row"] for r in rows} == {3}
    # Repeated rows are one document: both stay. The row without an id comes last and is emptied.
    assert [r["n_dropped"] for r in rows if r["doc_id"] == 1] == [0, 0]
    assert [(r["text"], r["emptied"]) for r in rows if r["doc_id"] is None] == [("", True)]
    assert line_dedup.without_repeated_lines(clashing.where("false"), "doc_id", "text").count() == 0


def test_no_python_in_the_plan(spark, odd_docs):
    plan = line_dedup.dropped_lines(odd_docs, "doc_id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
