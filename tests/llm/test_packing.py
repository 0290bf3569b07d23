import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oresmith.llm import packing
from oresmith.llm.queries import PACK_TOKENIZER, QUERIES
from tests.conftest import SMALL


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), min_size=1, max_size=12))
def test_mixtures_use_every_piece_once_and_fit(counts):
    used = Counter()
    for mixture, times in packing.mixtures(counts, 64):
        assert times > 0 and sum(n * k for n, k in mixture.items()) <= 64
        for n, k in mixture.items():
            used[n] += k * times
    assert used == Counter(counts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), min_size=1, max_size=5))
def test_a_window_has_the_least_padding_possible(counts):
    longest = max(counts)
    items = [n for n, c in counts.items() for _ in range(c)]
    items.remove(longest)
    sums = {longest}
    for n in items:
        sums |= {s + n for s in sums if s + n <= 32}
    chosen = packing.least_padded(counts, 32)
    assert chosen[longest] >= 1 and all(k <= counts[n] for n, k in chosen.items())
    total = sum(n * k for n, k in chosen.items())
    assert packing.padding(total, 32) == min(packing.padding(s, 32) for s in sums)


def check(rows, texts):
    tokenizer = Tokenizer.from_file(PACK_TOKENIZER)
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append(r)
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert set(documents) == set(texts)
    for doc, pieces in documents.items():
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        end = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == end and p["doc_tokens"] == len(ids)
            end += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : end].tobytes())
        assert end == len(ids)
    return sequences


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sequences = check(QUERIES["op5_minimum_bin_slack"](spark, SMALL).collect(), texts)
    totals = [sum(n for _, n in pieces) for pieces in sequences.values()]
    assert sum(packing.padding(t, 1024) for t in totals) < 0.05 * sum(totals)


def test_odd_rows_and_a_special_token(spark, odd_docs):
    more = spark.createDataFrame([(7, "a <|endoftext|> b", "en", 0.0)], odd_docs.schema)
    docs = odd_docs.where("doc_id <> 1").union(more)
    digest = F.crc32("ids").alias("ids_crc32")
    rows = packing.pack_documents(docs, "doc_id", "text", PACK_TOKENIZER, digest).collect()
    check(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    with_ids = packing.pack_documents(odd_docs, "doc_id", "text", PACK_TOKENIZER)
    assert with_ids.where("doc_id = 1").count() == 2 and with_ids.where("doc_id IS NULL").count() == 1
    assert with_ids.where(F.octet_length("ids") != 4 * F.col("length")).count() == 0


def test_empty_table(spark, odd_docs):
    assert packing.pack_documents(odd_docs.where("false"), "doc_id", "text", PACK_TOKENIZER).count() == 0
