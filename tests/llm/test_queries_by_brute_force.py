"""The registered queries that SQL can't express, over whole tables, against plain Python."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import registry
from gridloom.llm.decontaminate import LEAST, THRESHOLD, _words
from gridloom.llm.token_store import tokenizer_file

from .test_duplicates import brute_groups, brute_print, plain_tiling

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return sorted(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def rows(spark, name):
    return sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()))


def test_op1(spark, documents):
    theirs, start, want = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), 0, []
    for i, t in documents:
        ids = [*theirs.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert rows(spark, "op1_rans_token_store") == want


def test_op2(spark, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = []
    for i, t in documents:
        doc = _words(t.lower())
        runs = {tuple(doc[k : k + LEAST]) for k in range(len(doc) - LEAST + 1)}
        for j, text in items:
            item = _words(text.lower())
            if len(item) >= LEAST and any(tuple(item[k : k + LEAST]) in runs for k in range(len(item) - LEAST + 1)):
                n = plain_tiling(doc, item, LEAST)
                if n >= THRESHOLD * len(item):
                    want.append((i, j, len(item), n, n / len(item)))
    assert [r[:5] for r in rows(spark, "op2_greedy_tiling")] == sorted(want) != []


def test_op4(spark, documents):
    theirs = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows(spark, "op4_byte_bpe") == [(i, len(ids := theirs.encode(t, add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))) for i, t in documents]


def test_op6(spark, documents):
    prints = {i: brute_print(t) for i, t in documents}
    groups, least = brute_groups(set(prints.values())), {}
    for i in sorted(prints):
        least.setdefault(groups[prints[i]], i)
    assert rows(spark, "op6_simhash_pigeonring") == [(i, f"{prints[i]:016x}", least[groups[prints[i]]]) for i, _ in documents]


def test_op7(spark, documents):
    sizes = [len(t.encode()) + 1 for _, t in documents]
    total, before, want, slots = sum(sizes), 0, [], {}
    for (i, t), size in zip(documents, sizes, strict=True):
        shard = (2 * before + size) * 16 // (2 * total)
        want.append((i, size, zlib.crc32(t.encode()), "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
        before += size
    assert rows(spark, "op7_byte_prefix_shards") == want
