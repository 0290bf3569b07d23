import hashlib
import random
import struct
import time

import public_tokenizers
import pytest
import tiktoken

from oresmith.llm import bpe_monoid
from oresmith.llm.queries import BPE_RANKS, QUERIES
from tests.conftest import SMALL

RANKS = bpe_monoid.read_ranks(BPE_RANKS)
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe_monoid.TextEncoder(RANKS, PATTERN)


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_tree_equals_direct_merging():
    monoid, choose = bpe_monoid.BpeMonoid(RANKS), random.Random(3)
    tokens = list(RANKS)
    for trial in range(1500):
        data = b"".join(choose.choice(tokens) for _ in range(choose.randint(0, 25)))
        if trial % 2:
            data = bytes(choose.choice(b"abe \x80\xc3\xa9th") for _ in range(choose.randint(0, 150)))
        assert monoid.encode(data) == monoid.merge(data)


def test_join_is_associative_with_the_empty_encoding_as_neutral():
    monoid, choose = bpe_monoid.BpeMonoid(RANKS), random.Random(4)
    for _ in range(300):
        a, b, c = (monoid.encode(bytes(choose.choice(b"then aing") for _ in range(choose.randint(0, 12)))) for _ in range(3))
        assert monoid.join(monoid.join(a, b), c) == monoid.join(a, monoid.join(b, c))
        assert monoid.join([], a) == a == monoid.join(a, [])


@pytest.mark.parametrize(
    "text",
    ["", " ", "  a  b ", "a\n\n b\t c  \n", "I'm it's 'll we'Re", "x\x1c y\x85z \xa0 q", "a" * 5000, "é" * 999 + " 12 67", "\U0001f600 hi", "tab\t tab"],
)
def test_ids_equal_the_library_and_decode_to_the_text(library, encoder, text):
    ids = encoder.encode(text)
    assert unpacked(ids) == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_random_texts(library, encoder):
    choose = random.Random(5)
    for _ in range(2000):
        text = "".join(choose.choice(" \n\tab'st1,é　\x1c") for _ in range(choose.randint(0, 25)))
        assert unpacked(encoder.encode(text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "=", "ab", "é", "word", "\u4e2d"])
def test_long_runs_take_seconds(library, encoder, unit):
    text = unit * (200_000 // len(unit.encode()) + 1)
    started = time.process_time()
    ids = encoder.encode(text)
    assert time.process_time() - started < 10
    # The library itself takes long for such runs, so a shorter one is compared.
    assert encoder.decode(ids) == text.encode()
    short = unit * 3001
    assert unpacked(encoder.encode(short)) == library.encode_ordinary(short)


def test_heap_and_scan_merge_alike():
    monoid, choose = bpe_monoid.BpeMonoid(RANKS), random.Random(6)
    for _ in range(400):
        data = bytes(choose.choice(b"aab the\xc3\xa9=") for _ in range(choose.randint(0, 64)))
        assert monoid._merge_by_heap(data) == monoid.merge(data)


def test_columns(spark, odd_docs, library):
    done = odd_docs.select("text", bpe_monoid.encode("text", BPE_RANKS, PATTERN).alias("ids"))
    rows = done.select("text", bpe_monoid.unpack("ids").alias("list"), bpe_monoid.decode("ids", BPE_RANKS, PATTERN).alias("back")).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert row["list"] == library.encode_ordinary(row["text"] or "")
        assert bytes(row["back"]) == (row["text"] or "").encode()


def test_query_against_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op9_monoid_bpe"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = library.encode_ordinary(docs[row["doc_id"]] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((docs[row["doc_id"]] or "").encode()).hexdigest()
