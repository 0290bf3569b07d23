import random
import re

import pytest
from pyspark.sql import functions as F

from oresmith.operators import corpus
from oresmith.operators.near_duplicates import near_duplicates

CODE = "import os\n\n  # note\ndef check_rule(x):\r\n    return x.isNull()  # later\n\t\n\u00a0\nissue_frame('t')"


def test_text_files(spark, tmp_path):
    (tmp_path / "data_quality").mkdir()
    (tmp_path / "data_quality" / "02_checks.py").write_text("a\nb\n")
    (tmp_path / "01_load.py").write_text("c")
    (tmp_path / "notes.txt").write_text("ignored")
    got = corpus.with_path_labels(corpus.text_files(spark, str(tmp_path)), default_layer="catalog")
    rows = {r.file_name: (r.job, r.layer, r.is_data_quality, r.text) for r in got.collect()}
    assert rows == {
        "02_checks.py": ("02_checks", "silver", True, "a\nb\n"),
        "01_load.py": ("01_load", "bronze", False, "c"),
    }


def test_lines_match_a_plain_python_count(spark):
    texts = [CODE, "", "\n\n", "# only", "x\u2028y\x0bz\x85w"]
    patterns = [r"\.isNull\(\)", r"issue_frame\("]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.code_lines, r.pattern_lines) for r in corpus.pattern_lines(df, "text", patterns).collect()}
    for n, text in enumerate(texts):
        lines = [s for s in text.splitlines() if s.strip() and not s.strip().startswith("#")]
        hits = [s for s in lines if any(re.search(p, s) for p in patterns)]
        assert got[n] == (len(lines), len(hits))


def test_counting_lines_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    plan = corpus.pattern_lines(df, "text", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_identifiers(spark):
    df = spark.createDataFrame(
        [(1, 'rule("A_1") rule("A_1") lit("B_2")'), (2, 'lit("A_1")'), (3, None)], "id int, text string"
    )
    got = corpus.identifier_counts(df, "id", "text", [r'rule\("([^"]+)"', r'lit\("([^"]+)"'])
    assert sorted(tuple(r) for r in got.collect()) == [("A_1", 3, 2), ("B_2", 1, 1)]


def test_clone_report(spark):
    df = spark.createDataFrame(
        [("a", 'f("x", 1)\nonly a\n\nf("y", 2)'), ("b", "f('z', 99)\nonly b"), ("c", "c c")], "g string, text string"
    )
    got = {r.g: tuple(r)[1:] for r in corpus.clone_report(df, "text", "g").collect()}
    assert got == {"a": (3, 1, 1), "b": (2, 1, 0), "c": (1, 0, 0)}


def normalized(text):
    text = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "STR", text.lower())
    return re.sub(r"\s+", " ", re.sub(r"\b\d+\b", "NUM", text)).strip(" ")


def brute_force(texts, threshold, width=3):
    sets = {}
    for n, text in texts:
        words = normalized(text).split(" ")
        sets[n] = {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))}
    ids = sorted(sets)
    return sorted(
        y
        for y in ids
        if any(len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]) - 1e-9 for x in ids if x < y)
    )


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_near_duplicates_match_brute_force(spark, threshold):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    common = "this notice stands in every second text of the collection"
    template = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for n in range(160):
        if n % 3 == 0:  # a third of all texts: near copies of one template
            words = list(template)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 50))]
            if n % 2 == 0:
                words = common.split() + words
        texts.append((n, " ".join(words)))
    texts += [(200, texts[1][1]), (201, texts[1][1].upper()), (202, ""), (203, ""), (204, "one two"), (205, "one  two")]
    texts += [(206, "call 12 times"), (207, "call 77 times"), (208, 'say "a"'), (209, 'say "b c"')]
    df = spark.createDataFrame(texts, "id bigint, text string")
    got = sorted(r.id for r in near_duplicates(df, "id", "text", threshold).collect())
    assert got == brute_force(texts, threshold)
    assert len(got) > 50


def test_only_copies(spark):
    df = spark.range(500).select("id", F.lit("always the same few words").alias("text"))
    assert near_duplicates(df, "id", "text").count() == 499


@pytest.mark.parametrize("threshold", [0.8])
def test_a_shared_shingle_makes_no_candidates_of_texts_that_differ(spark, threshold, monkeypatch):
    """Half of all texts share one shingle and little else: no text meets all of them."""
    from oresmith.operators import near_duplicates as module

    rng, texts = random.Random(3), []
    for n in range(300):
        words = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(8, 40))]
        texts.append((n, " ".join(words + ["one two three"] * (n % 2))))
    seen = []
    original = module.candidate_pairs

    def counted(*args):
        seen.append(original(*args).count())
        return original(*args)

    monkeypatch.setattr(module, "candidate_pairs", counted)
    got = near_duplicates(spark.createDataFrame(texts, "id bigint, text string"), "id", "text", threshold)
    assert sorted(r.id for r in got.collect()) == brute_force(texts, threshold)
    assert seen and max(seen) < 2 * len(texts)


def _shuffled(spark):
    """Bytes that the session's tasks have shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_sets_of_texts_in_no_pair_are_not_shuffled(spark):
    """Long texts of which few have a near copy: their shingles are shuffled once, their sets are not."""
    rng = random.Random(5)
    texts = [(n, " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) + "x" for _ in range(300))) for n in range(400)]
    texts += [(1000 + n, texts[n][1] + " more") for n in range(10)] + [(2000 + n, texts[n][1]) for n in range(20, 30)]
    df = spark.createDataFrame(texts, "id bigint, text string").cache()
    df.count()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all sides were large
    try:
        before = _shuffled(spark)
        got = sorted(r.id for r in near_duplicates(df, "id", "text").collect())
        moved = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        df.unpersist()
    assert got == [*range(1000, 1010), *range(2020, 2030)]
    assert moved < 3 * 8 * sum(len(text.split()) for _, text in texts)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_shingles_of_very_many_texts_are_counted_before_the_shuffle(spark, threshold, monkeypatch):
    """The same result where the rows of some shingles are too many for one task, and ids share hashed places."""
    from oresmith.operators import near_duplicates as module

    rng, texts = random.Random(11), []
    template = [f"w{rng.randrange(300)}" for _ in range(40)]
    for n in range(150):
        words = [w if rng.random() > 0.02 else f"v{n}" for w in template] if n % 3 == 0 else []
        texts.append((n, " ".join(words + [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 30 if words else 50))])))
        texts.append((1000 + n, texts[-1][1] if n % 5 == 0 else f"one two three {n % 7} w{n}"))
    monkeypatch.setattr(module, "MOST_IN_TASK", 20)
    monkeypatch.setattr(module, "TOKEN_BUCKETS", 64)
    monkeypatch.setattr(module, "ROW_BITS", 16)
    monkeypatch.setattr(module, "MOST_BITS", 64)
    got = near_duplicates(spark.createDataFrame(texts, "id bigint, text string"), "id", "text", threshold)
    assert sorted(r.id for r in got.collect()) == brute_force(texts, threshold)


def test_pairs_of_very_many_equal_lines(spark):
    from oresmith.operators.corpus import _pairs_of

    pairs = spark.sql("SELECT 4000000000L AS n").select(_pairs_of(F.col("n")).alias("p")).first()["p"]
    assert int(pairs) == 4_000_000_000 * 3_999_999_999 // 2


@pytest.mark.parametrize("block", ["128m", "50b", "7b"])
def test_files_by_block_equal_whole_files(spark, tmp_path, block):
    """Lines in order and counts alike, however small the blocks that a file is cut into."""
    lines = ["first", "", "# note", "AB CDEF 123-4567", "é" * 9, "token XYZW", '"' + "a" * 40 + '"', "last line"]
    (tmp_path / "d").mkdir()
    for name, end in (("a", "\n"), ("b", "\r\n"), ("c", "\r")):
        (tmp_path / "d" / f"{name}.txt").write_bytes(end.join(lines * 12).encode())
    (tmp_path / "d" / "empty.txt").write_bytes(b"")
    (tmp_path / "d" / "other.log").write_bytes(b"no\n")
    patterns, ids = ["token"], ["([0-9]{3}-[0-9]{4})", "([A-Z]{4,})"]
    setting = "spark.sql.files.maxPartitionBytes"
    size = spark.conf.get(setting)
    spark.conf.set(setting, block)
    try:
        read = corpus.text_lines(spark, str(tmp_path / "d"), ".txt")
        rows = read.collect()
        counts = {r.path.rsplit("/", 1)[1]: r for r in corpus.file_counts(read, patterns, ids).collect()}
    finally:
        spark.conf.set(setting, size)
    for name in "abc":
        mine = sorted((r.line_number, r.line) for r in rows if r.path.endswith(f"/{name}.txt"))
        assert [line for _, line in mine] == lines * 12 and [n for n, _ in mine] == list(range(96))
    whole = corpus.pattern_lines(corpus.text_files(spark, str(tmp_path / "d"), ".txt"), "text", patterns)
    for r in whole.collect():
        name = r.path.rsplit("/", 1)[1]
        if name != "empty.txt":
            assert (counts[name].code_lines, counts[name].pattern_lines) == (r.code_lines, r.pattern_lines)
            assert (counts[name].lines, counts[name].identifiers) == (96, 36)
