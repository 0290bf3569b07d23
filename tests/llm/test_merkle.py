import hashlib
import random

import pytest

from oresmith.llm import merkle
from oresmith.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """The root, and per leaf the (left, right) siblings on its way, by the definition."""
    ways, nodes, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, node in enumerate(of):
            run = nodes[node // 3 * 3 : node // 3 * 3 + 3]
            ways[i].append((run[: node % 3], run[node % 3 + 1 :]))
        of = [node // 3 for node in of]
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def brute(rows):
    """{doc_id: (leaf, subroot, root, proof)} of (doc_id, source, text) rows."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subroots, found = [], []
    for source in sources:
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        leaves = [leaf(*r) for r in mine]
        root, ways = tree(leaves)
        subroots.append(root)
        found.append([(r[0], d, way) for r, d, way in zip(mine, leaves, ways)])
    top, above = tree(subroots)
    result = []
    for of_source, subroot, more in zip(found, subroots, above):
        for doc, digest, way in of_source:
            beside = [d for left, right in way + more for d in left + right]
            result.append((doc, digest, subroot, top, h(*beside)))
    return sorted(result, key=repr)


def manifest(spark, rows, levels):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    return merkle.manifest(frame, "source", "doc_id", frame.columns, {"doc_id": frame["doc_id"]}, levels)


def digests(found):
    hexed = [(r["doc_id"], *[bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "siblings")]) for r in found.collect()]
    return sorted([(*r[:4], h(r[4])) for r in hexed], key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_against_the_definition(spark, levels):
    choose = random.Random(levels)
    sources = [None, "", "a", "b", "é", "z", "\U0001f600", "￮"] + [f"s{i}" for i in range(6)]
    rows = [(i, "hot", f"text {i}\n") for i in range(100)]
    rows += [(choose.randrange(300), choose.choice(sources), choose.choice(["x", "", None, "é\n"])) for _ in range(80)]
    rows += [(None, "a", "no id"), (None, "a", None), (7, "b", "again"), (7, "b", "again"), (1, "lone", "one")]
    found = manifest(spark, rows, levels)
    assert digests(found) == brute(rows)
    folded = found.withColumn("to", merkle.folded(found["leaf"], found["siblings"], found["shape"]))
    assert folded.where("to = root").count() == len(rows)
    # Another leaf on the same way leads elsewhere.
    wrong = found.withColumn("to", merkle.folded(found["subroot"], found["siblings"], found["shape"]))
    assert wrong.where("to <> root").count() == sum(r[1] != "lone" for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 30])
def test_appender_by_size(n):
    leaves = [h(str(i)) for i in range(n)]
    appender = merkle.Appender()
    for digest in leaves:
        appender.append(bytes.fromhex(digest))
    root, ways = tree(leaves)
    assert appender.finish(merkle.least_height(n)).hex() == root
    for i, way in enumerate(ways):
        assert appender.siblings[i].hex() == "".join(d for left, right in way for d in left + right)
        assert merkle.fold(bytes.fromhex(leaves[i]), bytes(appender.siblings[i]), bytes(appender.shapes[i])).hex() == root


def test_partial_witnesses_grow_as_siblings_come():
    appender = merkle.Appender()
    lengths = []
    for i in range(9):
        appender.append(hashlib.sha256(b"%d" % i).digest())
        lengths.append(len(appender.shapes[0]))
    assert lengths == [0, 0, 1, 1, 1, 1, 1, 1, 2]


def test_one_row_and_no_row(spark):
    assert digests(manifest(spark, [(5, None, None)], 7)) == brute([(5, None, None)])
    frame = spark.createDataFrame([], "doc_id long, source string, text string")
    assert merkle.manifest(frame, "source", "doc_id", frame.columns, {"doc_id": frame["doc_id"]}).count() == 0


def test_clashing_columns_and_long_texts(spark, odd_docs):
    clashing = odd_docs.selectExpr("*", "1 AS tree", "2 AS rank", "3 AS digest", "4 AS root", "5 AS leaf", "6 AS n", "7 AS row")
    keep = {"doc_id": clashing["doc_id"], "shape_of_row": clashing["row"]}
    found = merkle.manifest(clashing, "lang", "doc_id", clashing.columns, keep)
    assert found.columns == ["doc_id", "shape_of_row", "leaf", "subroot", "root", "siblings", "shape"]
    assert found.count() == 8 and found.select("root").distinct().count() == 1


def test_query_finds_tampered_rows(spark, tmp_path):
    rows = [(i, "one line" if i % 3 else "two\nlines", "en", f"s{i % 4}", 8) for i in range(60)] + [(99, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    from zlib import crc32

    found = {r["doc_id"]: r for r in QUERIES["op11_incremental_merkle"](spark, str(tmp_path)).collect()}
    for doc, text, *_ in rows:
        tampered = crc32(str(doc).encode()) % 2 == 0 and "\n" in (text or "")
        assert found[doc]["verified"] == (not tampered)
        assert (found[doc]["folded_root"] == found[doc]["root"]) == (not tampered)
