import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import bpe, rans, token_store
from gridloom.llm._shared import new_path
from gridloom.llm.token_store import tokenizer_file

from .helpers import docs, wide

ODD = ["", " ", "\n\t ", "a\x1cb \x1f c\x85d e", "AaAa ΣΑΣ. ΟΔΟΣ, İstanbul ẞ", "<|endoftext|>hi<|endoftext|><|endoftext|> x <|endoftext", "don't we'll I'M\n\n\n  x  ", "日本語テキスト🙂🙂 ½²³ ٣٤ ²., ½. x", "é café. nõ, ÿ.. a., b.,. c!. d_. Ä. ß, µ º. ª ", "aaaa aaaaaaaaa", "\x00\x01", "word. " * 3000, "x" * 5000]
ODD += ["a <|EndOfText|> b", "<|endoftext|><|ENDOFTEXT|> Don't", "x<|StartOfText|>É <|startoftext|>"]
_rng = random.Random(4)
ODD += ["".join(chr(_rng.choice([_rng.randrange(32, 127), _rng.randrange(0x20, 0x3000), _rng.randrange(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(100)]
ODD += ["".join(_rng.choice("ab c'st\n\t1.,éÀ_!") for _ in range(80)) for _ in range(200)]


def library(name):
    return Tokenizer.from_file(tokenizer_file(name))


def runs(ids, lens):
    return [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]


def test_word_cache_is_the_library():
    assert runs(*token_store.WordCache(tokenizer_file("word_bpe_49k.json")).encode(ODD)) == [e.ids for e in library("word_bpe_49k.json").encode_batch(ODD, add_special_tokens=False)]


def test_every_letter_before_a_stop():
    """All code points, and mixtures of those that composing or lower-casing take apart, before stops."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    changed = [c for c in chars if unicodedata.normalize("NFC", c).lower() != c]
    texts = [f"a{c}. b{c}, {c}x.\n" for c in chars]
    texts += ["".join(_rng.choice([*_rng.choices(changed, k=3), "a", "\u0301", "\u0307", ". ", ", ", ".\n", " ", "<|endoftext|>"]) for _ in range(12)) for _ in range(20_000)]
    ours, theirs = token_store.WordCache(tokenizer_file("word_bpe_49k.json")), library("word_bpe_49k.json")
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        assert runs(*ours.encode(part)) == [e.ids for e in theirs.encode_batch(part, add_special_tokens=False)]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_store.WordCache(tokenizer_file("byte_bpe_50k.json"))


def test_merge_rounds_are_the_library():
    own, theirs = bpe.ByteBpe(tokenizer_file("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    ids, lens = own.encode(ODD)
    assert runs(ids, lens) == [e.ids for e in theirs.encode_batch(ODD, add_special_tokens=False)]
    assert own.decode(ids, lens) == [theirs.decode(x, skip_special_tokens=False) for x in runs(ids, lens)]
    broken = [[_rng.randrange(50300) for _ in range(30)] for _ in range(50)]
    assert own.decode(np.concatenate(broken), np.full(50, 30)) == [theirs.decode(x, skip_special_tokens=False) for x in broken]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 65536, 65537, 200_001])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 40_000).astype(np.uint32)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=5)))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    if n > 300:
        with pytest.raises(ValueError):
            rans.decode(block._replace(words=bytes([block.words[0] ^ 1]) + block.words[1:]), table)
        with pytest.raises(ValueError):
            rans.decode(block._replace(ids_crc32=1), table)


@pytest.mark.parametrize("ids", [[], [0], [65535, 2], [65536, 1, 2**32 - 1]])
def test_packed_ids(ids):
    assert token_store.unpack(token_store.pack(np.array(ids, dtype=np.uint32))).tolist() == ids


def test_scaled_keeps_rare_ids():
    freq = rans.scaled(np.array([10**9, 1, 0, 1]))
    assert freq.sum() == 1 << rans.BITS and freq[1] == freq[3] >= 1 and freq[2] == 0


def test_store(spark):
    rows = [(5, "Hello there, hello."), (2, None), (2, ""), (9, "the end " * 900), (None, "nobody"), (5, "Hello there, hello."), (1, "<|endoftext|> x"), (6, "M. İ. Yılmaz, \u0958. \u09dc, e\u0301. x")]
    path = new_path(spark, "t")
    token_store.write(wide(spark, rows), path, tokenizer_file("word_bpe_49k.json"), end_id=2, block=100)
    got = token_store.read(spark, path).orderBy("start").collect()
    theirs, start = library("word_bpe_49k.json"), 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)


def test_store_of_nothing(spark):
    path = new_path(spark, "t")
    token_store.write(docs(spark, []), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    assert token_store.read(spark, path).count() == 0


def test_bpe_digests(spark):
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, None), (3, ""), (4, "<|endoftext|>"), (5, "y" * 20_000)]
    got = bpe.digests(wide(spark, rows), tokenizer_file("byte_bpe_50k.json")).collect()
    theirs = library("byte_bpe_50k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := theirs.encode(t or "", add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(docs(spark, []), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_there_and_back_takes_one_worker(spark):
    """Chained, encoding and decoding have two Python workers for each task at a time, each with a vocabulary."""
    rows = wide(spark, [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, None), (3, ""), (4, "<|endoftext|> ½²"), (5, "y" * 20_000)])
    path = tokenizer_file("byte_bpe_50k.json")
    for out in (bpe.digests(rows, path), corpus_pipeline.tokens(spark, rows, "")):
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    ids = bpe.encoded(rows, path, ("source",))
    apart = bpe.decoded(ids, path, ("n_tokens", "source"), with_ids=True).select("doc_id", "n_tokens", "ids", "text", "source")
    got, want = (sorted(x.collect(), key=str) for x in (bpe.round_trip(rows, path, ("source",)), apart))
    assert got == want and [r["text"] for r in got if r["doc_id"] == 4] == ["<|endoftext|> ½²"]


def test_texts_are_coded_in_parts(monkeypatch):
    """What a worker holds of words and ids is bounded, whatever a batch has."""
    texts, seen = [f"w{i} " * 50 for i in range(200)], []
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["doc_id", "text"])
    encode = bpe.ByteBpe.encode
    monkeypatch.setattr(bpe, "PART_CHARS", 5_000)
    monkeypatch.setattr(bpe.ByteBpe, "encode", lambda self, part: seen.append(sum(map(len, part))) or encode(self, part))
    made = bpe.coder(tokenizer_file("byte_bpe_50k.json"), back=True)(iter([batch]))
    assert [t for b in made for t in b.column("text").to_pylist()] == texts and max(seen) < 5_500 and len(seen) > 5


def test_ids_are_counted_in_blocks(monkeypatch):
    """A count as long as the vocabulary for each block of texts, not for each text."""
    rng, calls, bincount = np.random.default_rng(1), [], np.bincount
    texts = [rng.integers(0, rng.integers(1, 49_000), rng.integers(0, 30)).astype("<u2") for _ in range(3000)]
    want = bincount(np.concatenate(texts))
    monkeypatch.setattr(token_store.np, "bincount", lambda x: calls.append(len(x)) or bincount(x))
    assert (token_store.totals(iter(texts)) == want).all() and len(calls) == 1
    assert (token_store.totals(iter(texts), 1000) == want).all() and len(calls) < 60
    assert len(token_store.totals(iter([]))) == 0
