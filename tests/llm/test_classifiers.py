import numpy as np

from oresmith.llm import language, toxicity
from oresmith.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def test_factorization_machine_learns_a_pair_of_terms():
    choose = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(1200):
        insult, group = (choose.random(2) < 0.5).tolist()
        words = [f"w{i}" for i in choose.integers(0, 50, 8)] + ["insult"] * insult + ["group"] * group
        texts.append(" ".join(words))
        labels.append(int(insult and group))
    bits = 16
    machine = toxicity.fit([np.array(toxicity.term_places(t, bits)) for t in texts], np.array(labels), bits)
    scores = {t: machine.score(t) for t in ("insult group", "insult", "group", "w1 w2", "", None)}
    assert scores["insult group"] > 0.9
    assert max(v for k, v in scores.items() if k != "insult group") < 0.3
    assert machine.logit("insult group") > machine.logit("insult") + machine.logit("group") - machine.bias


def test_a_pair_of_terms_that_tell_nothing_alone():
    """Each term comes as often with either label, like all others; only both or none is toxic."""
    choose = np.random.default_rng(2)
    vocabulary = ["".join(chr(97 + c) for c in choose.integers(0, 26, 5)) for _ in range(200)]
    texts, labels = [], []
    for _ in range(4000):
        a, b = (choose.random(2) < 0.5).tolist()
        words = [vocabulary[i] for i in choose.integers(0, 200, 12)] + ["alpha"] * a + ["beta"] * b
        texts.append(" ".join(words))
        labels.append(int(a == b))
    places = [np.array(toxicity.term_places(t, 16)) for t in texts]
    machine = toxicity.fit(places, np.array(labels), 16)
    assert len(machine.rows) < 20
    right = [(machine.score(t) > 0.5) == y for t, y in zip(texts, labels)]
    assert np.mean(right) > 0.99
    assert min(machine.score("alpha beta w1"), machine.score("w1")) > 0.9 > 0.1 > max(machine.score("alpha"), machine.score("beta w2"))


def test_scores_are_the_sum_over_pairs():
    choose = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in choose.integers(0, 26, 6)) for _ in range(30)]
    texts = [" ".join(choose.choice(words, 6)) for _ in range(300)]
    labels = np.array([int(words[1] in t.split() or words[2] in t.split()) for t in texts])
    machine = toxicity.fit([np.array(toxicity.term_places(t, 12)) for t in texts], labels, 12)
    assert len(machine.rows) >= 2
    for text in texts[:50]:
        rows = [machine.rows[p] for p in toxicity.term_places(text, 12) if p in machine.rows]
        logit = machine.bias + sum(machine.linear[i] for i in rows)
        logit += sum(machine.factors[i] @ machine.factors[j] for at, i in enumerate(rows) for j in rows[:at])
        assert abs(machine.score(text) - 1 / (1 + np.exp(-logit))) < 1e-9


def test_factorization_machine_without_both_labels():
    machine = toxicity.fit([np.array([1, 2])], np.array([0]), 8)
    assert 0 <= machine.score("anything") < 0.5


def test_toxicity_query_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = QUERIES["op3_factorization_machine"](spark, MEDIUM).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in known) / len(known) >= 0.9
    assert not any(p for p, y in known if y == 0)


def test_toxicity_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    machine = toxicity.learn(odd_docs, labels)
    scored = toxicity.score_documents(odd_docs, machine).collect()
    assert len(scored) == 8 and all(0 <= r["score"] <= 1 for r in scored)
    empty = odd_docs.where("false")
    assert toxicity.score_documents(empty, toxicity.learn(empty, labels.where("false"))).count() == 0


def test_language_query_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = QUERIES["op6_string_kernel"](spark, MEDIUM).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) >= 0.98


def test_kernel_against_sets_of_ngrams():
    def grams(text):
        text = f" {text} "
        return {text[i : i + n] for n in language.LENGTHS for i in range(len(text) - n + 1)}

    a, b = "some words here", "other words there"
    pa, pb = language.presence(a), language.presence(b)
    columns = np.union1d(pa, pb)
    rows = language.presence_rows([pa, pb], language.column_of(columns), len(columns))
    exact = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    assert abs(rows[0] @ rows[1] - exact) < 0.03
    assert language.presence(None) is None and language.presence("12 34 !?") is None


def test_language_of_odd_rows(spark, odd_docs):
    classifier = language.learn(odd_docs)
    found = {(r["doc_id"], r["lang_pred"] == "und") for r in language.predict_documents(odd_docs, classifier).collect()}
    assert found == {(1, False), (2, True), (3, True), (4, True), (None, False), (5, False), (6, True)}
    empty = odd_docs.where("false")
    nothing = language.learn(empty)
    assert language.predict_documents(empty, nothing).count() == 0
    assert {r["lang_pred"] for r in language.predict_documents(odd_docs, nothing).collect()} == {"und"}


def test_a_rare_language_is_learned(spark):
    """One of 5,000 documents is in it, so a sample of all of them would hold none or one."""
    choose = np.random.default_rng(5)

    def prose(letters):
        return " ".join("".join(choose.choice(list(letters), 5)) for _ in range(30))

    rows = [(i, prose("abcdefgh"), "x") for i in range(3000)] + [(i, prose("hijklmno"), "y") for i in range(3000, 5000)]
    rows += [(5000 + i, prose("opqrstuv"), "rare") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    classifier = language.learn(docs, sample=300)
    assert classifier.languages == ["rare", "x", "y"]
    found, scores = classifier.predict([prose("opqrstuv"), prose("abcdefgh"), prose("hijklmno")])
    assert found == ["rare", "x", "y"] and min(scores) > 0.5


def test_large_alphabets_do_not_fill_the_places():
    choose = np.random.default_rng(6)
    text = "".join(chr(c) for c in choose.integers(0x4E00, 0x9FFF, 30_000))
    assert len(language.presence(text)) < 0.35 * (1 << language.BITS)
