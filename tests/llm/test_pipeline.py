from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oresmith.llm.common import step_folder, stored
from tests.llm.test_packing import check
from tests.llm.test_partenum import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """What each stage makes of the stage before it."""
    folder, frames = step_folder(spark, "stages"), []
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), folder, name)
        frames.append((name, before, docs))
    return frames


def test_stages_keep_the_columns_and_only_take_rows(results):
    for name, before, after in results[:-1]:
        assert after.schema == before.schema, name
        assert not {r["doc_id"] for r in after.collect()} - {r["doc_id"] for r in before.collect()}


def test_toxic_documents_go_and_clean_ones_stay(spark, results):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    left = {r["doc_id"] for r in results[0][2].collect()}
    assert all(doc in left for doc, toxic in labels.items() if not toxic)


def test_languages_of_prose_stay(results):
    _, before, after = results[1]
    letters = before.where(F.col("text").rlike("\\p{L}")).count()
    assert after.count() == letters


def test_line_dedup_against_brute_force(results):
    from tests.llm.test_line_dedup import brute as lines

    _, before, after = results[2]
    left = lines([(r["doc_id"], r["text"]) for r in before.collect()])
    original = {r["doc_id"]: r["text"] for r in before.collect()}
    kept = [(doc, text) for doc, text in left if text == original[doc] or text.strip()]
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == sorted(kept)
    assert after.where("n_chars <> char_length(text)").count() == 0


def test_one_document_of_each_group_stays(results):
    _, before, after = results[3]
    groups = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(doc for doc, _, group in groups if doc == group)


def test_near_copies_by_five_words_and_four_fifths(spark):
    def grams(text):
        words = text.split()
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}

    base = [f"w{i}" for i in range(100)]
    texts = {}
    for doc, changed in enumerate([(), (50,), (20, 70), (20, 50, 80)], 1):
        texts[doc] = " ".join("x" if i in changed else w for i, w in enumerate(base))
    similar = {d: len(grams(texts[1]) & grams(t)) / len(grams(texts[1]) | grams(t)) for d, t in texts.items()}
    assert similar[2] >= 0.8 and similar[3] >= 0.8 > similar[4]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], COLUMNS)
    left = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SMALL).collect())
    chained = [d for d in texts if d > 1 and any(len(grams(texts[d]) & grams(texts[e])) >= 0.8 * len(grams(texts[d]) | grams(texts[e])) for e in texts if e < d)]
    assert left == [d for d in texts if d not in chained]


def test_jaccard_stage_against_brute_force_of_its_own_bound(results):
    _, before, after = results[3]
    groups = brute([(r["doc_id"], r["text"]) for r in before.collect()], percent=80, width=5)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(doc for doc, _, group in groups if doc == group)


def test_rows_without_an_id_or_with_a_repeated_one_go_by_their_own_text(spark):
    prose = [f"{name} one two three four five six seven" for name in "abcde"]
    rows = [
        (1, prose[0]), (None, prose[0]), (None, prose[1]),  # only the copy without an id goes
        (2, prose[0]), (2, prose[2]),  # only the copy of two texts under one id goes
        (3, prose[3]), (3, prose[3]),  # one of two equal rows stays
        (None, prose[4]), (None, prose[4]), (None, prose[4]),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], COLUMNS)
    left = corpus_pipeline.keep_one_of_each_group(spark, docs, SMALL)
    assert left.schema == docs.schema
    expected = [(1, prose[0]), (2, prose[2]), (3, prose[3]), (None, prose[1]), (None, prose[4])]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(expected, key=repr)


def test_packed_pieces_are_the_documents_left(results):
    _, before, after = results[4]
    check(after.collect(), {r["doc_id"]: r["text"] for r in before.collect()})


def test_run_equals_the_stages(spark, results):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert Counter(map(key, rows)) == Counter(map(key, results[4][2].collect()))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "some words here", "en", "s", 15), (2, "some words here", "en", "s", 15), (2, "some words here", "en", "s", 15)]])
def test_odd_rows_pass_every_stage(spark, rows, tmp_path):
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} <= {2}


def test_extra_columns_with_clashing_names(spark, tmp_path):
    rows = [(1, "some words here and there", "en", "s", 25, 7, 8, True, 9), (2, "some words here and there", "en", "s", 25, 7, 8, True, 9)]
    docs = spark.createDataFrame(rows, COLUMNS + ", n_lines long, other_id long, emptied boolean, component_id long")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), str(tmp_path), name)
        assert all(tuple(r)[5:] == (7, 8, True, 9) for r in docs.collect())
    assert [r["doc_id"] for r in docs.collect()] == [1]
