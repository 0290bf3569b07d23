"""The registered queries of the operators in this package, with production parameters.

Each query applies its operator to the whole table and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oresmith.llm import (
    bpe_monoid,
    exact_dedup,
    graph_dedup,
    language,
    licenses,
    line_dedup,
    merkle,
    packing,
    partenum,
    periodic_runs,
    permutation_index,
    toxicity,
    url_rules,
)
from oresmith.llm.common import id_remainder, ship_package

Query = Callable[[SparkSession, str], DataFrame]

PACK_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

HOST_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
# Pages that hold no prose of their own, whatever their host.
PAGE_PATTERNS = [
    "^login^",
    "^signin^",
    "^signup^",
    "^register^",
    "^cart^",
    "^checkout^",
    "^wp-admin^",
    "^wp-login.php",
    "^admin^",
    "^search^",
    "^print=",
    "^share=",
    "^replytocom=",
    "^sessionid=",
    "^phpsessid=",
    "^ads^",
    "^adserver^",
    "^affiliate^",
    "^redirect*url=",
    "^casino^",
    "^porn^",
    "^page=*^ref=",
]
URL_RULES = [url_rules.host_rule(rule, verdict, (1, len(rule))) for rule, verdict in HOST_RULES] + [
    url_rules.PatternRule(f"pattern:{p}", p, "block", (0, len(p))) for p in PAGE_PATTERNS
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pruned_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of near-duplicate embeddings by range search on a pruned graph."""
    return graph_dedup.linked_vectors(_table(spark, folder, "embeddings"))


def op2_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20, among all others."""
    found = permutation_index.nearest(_table(spark, folder, "embeddings"), "id % 20 = 0")
    return found.select("query_id", "rank", "vec_id", "score")


def op3_factorization_machine(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by a factorization machine over hashed words."""
    docs = _table(spark, folder, "documents")
    machine = toxicity.learn(docs, _table(spark, folder, "labels"))
    return toxicity.score_documents(docs, machine)


def op4_license_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Licences that the known sentences of every document make, and the sentences."""
    found = licenses.scan_documents(_table(spark, folder, "documents"))
    complete = F.filter("licences", lambda f: f["complete"])
    return found.select(
        "doc_id",
        F.array_join("sentences", " ").alias("sentences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(complete, lambda f: f["name"]))), " ").alias("licences"),
        F.size(complete).cast("long").alias("n_licences"),
        F.array_join(F.transform("licences", lambda f: f["first_word"]), " ").alias("first_words"),
    )


def op5_minimum_bin_slack(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every tokenised document with its place in a sequence."""
    docs = _table(spark, folder, "documents")
    digest = F.crc32("ids").alias("ids_crc32")
    packed = packing.pack_documents(docs, "doc_id", "text", PACK_TOKENIZER, digest)
    return packed.withColumn("length", F.col("length").cast("long"))


def op6_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by string-kernel ridge regression."""
    docs = _table(spark, folder, "documents")
    return language.predict_documents(docs, language.learn(docs))


def op7_rarest_token_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url by the host rules, else by the page patterns, else allow.

    ``rule`` names the host rule; ``pattern`` the page pattern, where no host rule fits.
    """
    pages = _table(spark, folder, "pages")
    judged = url_rules.judge_urls(pages, "url", URL_RULES, ["page_id"])
    by_pattern = F.startswith("rule", F.lit("pattern:"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(~by_pattern, F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        F.when(by_pattern, F.col("rule")).alias("pattern"),
    )


def op8_partenum(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents with a Jaccard index of 0.9 or more over 3-word shingles."""
    return partenum.jaccard_components(_table(spark, folder, "documents"), "doc_id", "text")


def op9_monoid_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    pattern = public_tokenizers.PATTERN
    docs = _table(spark, folder, "documents")
    done = docs.select("doc_id", bpe_monoid.round_trip("text", BPE_RANKS, pattern).alias("done"))
    return done.select(
        "doc_id",
        bpe_monoid.n_tokens("done.ids").alias("n_tokens"),
        F.sha2("done.ids", 256).alias("ids_sha256"),
        F.sha2("done.decoded", 256).alias("decoded_sha256"),
    )


def op10_deletion_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """What line dedup leaves of every document: counts and a digest of the text."""
    docs = _table(spark, folder, "documents")
    left = line_dedup.without_repeated_lines(docs, "doc_id", "text")
    return left.select("doc_id", "n_lines", "n_dropped", "emptied", F.md5("text").alias("text_md5"))


def op11_incremental_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """A Merkle manifest of the documents, and whether each row, some tampered with, still fits it."""
    docs = _table(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in columns]
    found = F.when(id_remainder("doc_id", 2) == 0, F.unhex(merkle.row_digest(tampered)))
    keep = {"doc_id": F.col("doc_id"), "tampered": found}
    rows = merkle.manifest(docs, "source", "doc_id", columns, keep)
    start = F.coalesce("tampered", "leaf")
    rows = rows.withColumn("folded", merkle.folded(start, F.col("siblings"), F.col("shape")))
    return rows.select(
        "doc_id",
        *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_salted_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The group of equal texts of every document, and whether it is the one that stays."""
    groups = exact_dedup.exact_groups(_table(spark, folder, "documents"), "doc_id", "text")
    return groups.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """The documents' texts; every tenth, by its id's hash, repeats words from some place on."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", hashed.alias("h"), F.floor(hashed / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = F.expr("transform(words, (w, i) -> if(i < a, w, get(words, cast(a + (i - a) % p AS int))))")
    changed = rows.withColumn("planted", F.when(F.col("a").isNotNull(), F.array_join(place, " ")))
    return changed.select("doc_id", F.coalesce("planted", "text").alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of words of every document, planted ones included."""
    docs = _with_planted_periods(_table(spark, folder, "documents"))
    rows = docs.select("doc_id", periodic_runs.periodic_runs(F.col("text")).alias("found"))
    rows = rows.select("doc_id", F.col("found.runs").alias("runs"), F.col("found.collapsed").alias("collapsed"))
    # Longest first, then by start and period.
    ordered = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))
    rows = rows.withColumn("longest", F.array_min(ordered))
    line = F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.col1")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.col1") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_pruned_graph,
        op2_permutation_index,
        op3_factorization_machine,
        op4_license_sentences,
        op5_minimum_bin_slack,
        op6_string_kernel,
        op7_rarest_token_rules,
        op8_partenum,
        op9_monoid_bpe,
        op10_deletion_neighbourhood,
        op11_incremental_merkle,
        op12_salted_exact_dedup,
        op13_periodic_runs,
    )
}
