"""Token ids as compressed files: static rANS with frequency tables that all blocks share.

`write` tokenizes a table of documents and writes two Parquet tables below a path:

* `table`: token_id int, freq long: the frequencies, scaled to 2**20, of all ids of the corpus.
* `blocks`: a row for each block of whole documents, in files in ascending order of doc_id:
  part and seq (its place), part_start (ids before it in its part), doc_ids and doc_lens,
  n_tokens, the lanes' states at each checkpoint, the 32-bit words, and two checksums.

`read` decodes the blocks in parallel; a block needs the table and nothing else, and
its segments are decoded side by side from the checkpoints (see rans.py).

The ids are made with the tokenizers library, for each distinct word once: ids don't depend
on what stands beyond a space or line end, so words are cached within a task. This holds for files
with the steps of `STEPS` alone; others raise ValueError.

Null texts are empty: they have the end id alone. Null doc_ids come first and stay null.
Repeated rows and rows that share a doc_id all stay, ordered by their ids. An empty table gives
tables without rows. Other columns are left out. A long document makes one long block.
"""

from __future__ import annotations

import contextlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import rans
from gridloom.llm._shared import Pieces, Words, documents, dropped, flattened, gather, new_path, slices, starts_of, sums

#: Ids in a block, about.
BLOCK = 1 << 18
#: Words that are encoded as one text.
JOINED = 256
#: Words that a worker keeps with their ids; beyond it the cache begins anew.
CACHED = 700_000
#: A stop before a space and after a letter or digit that composing and lower-casing leave alone or turn into one letter begins and ends a piece of its own.
_STOP = re.compile(r"[.,](?=[ \n])(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ].)")
#: Words that a tokenizer which lower-cases, composes and cuts between letters and others leaves as they are.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch

#: What a tokenizer file has to do before its merges for words to be encoded alone (fixed values).
STEPS = {
    "normalizer": ["NFC", {"Regex": r"\s+"}, "Lowercase"],
    "pre_tokenizer": [{"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "ByteLevel"],
}

IDS_SCHEMA = "doc_id long, n_tokens long, packed binary"
BLOCK_SCHEMA = "part int, seq int, part_start long, doc_ids binary, doc_nulls binary, doc_lens binary, n_tokens long, states binary, offsets binary, words binary, words_crc32 long, ids_crc32 long"


def checked(path: str) -> str:
    """path, if the tokenizer file there has the steps that words are encoded alone for; else ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    told = {"normalizer": (spec["normalizer"] or {}).get("normalizers", []), "pre_tokenizer": (spec["pre_tokenizer"] or {}).get("pretokenizers", [])}
    found = {k: [step.get("pattern", step["type"]) for step in steps] for k, steps in told.items()}
    cut = next((s for s in told["pre_tokenizer"] if s["type"] == "Split"), {})
    odd = [t for t in spec["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])]
    if found != STEPS or (cut["behavior"], cut["invert"]) != ("Removed", True) or odd or spec["truncation"] or spec["padding"] or spec["model"].get("dropout"):
        raise ValueError(f"{path}: the token store knows files with the steps {STEPS} only")
    return path


class WordCache:
    """Ids of texts by the tokenizers library, with a cache of words, for a vocabulary that lower-cases and drops white space."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain, self.cached = Tokenizer.from_file(checked(path)), Tokenizer.from_file(path), cached
        self.plain.normalizer = None  # for plain words, which its steps would not change
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.plain.model.end_of_word_suffix or "\n")]] = True
        # found in the text as it stands, so that case matters
        self.raw = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.normalized]
        self.words, self.pieces = Words(), Pieces()

    def _add(self, words: list[str]) -> None:
        plain = np.fromiter((m is not None for m in map(_PLAIN, words)), dtype=bool, count=len(words))
        some, rest = list(compress(words, plain)), list(compress(words, ~plain))
        ids, lens = (np.concatenate(x) for x in zip(self._plain_ids(some), flattened([e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]), strict=True))
        order = np.empty(len(words), dtype=np.int64)
        order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(words))
        self.pieces.add(gather(ids, starts_of(lens)[order], lens[order]), lens[order])

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, many of them in one text, cut where an id ends a word."""
        joined = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids, _ = flattened([e.ids for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            return flattened([e.ids for e in self.plain.encode_batch_fast(words, add_special_tokens=False)])
        return ids, np.diff(last, prepend=-1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if len(self.words) > self.cached:
            self.words, self.pieces = Words(), Pieces()
        numbers, counts, look = [np.zeros(0, dtype=np.int64)], [], self.words.__getitem__
        for text in texts:
            with contextlib.suppress(UnicodeEncodeError):
                text.encode("latin-1")
                lower = text.lower()  # one to one among these characters
                if not any(t.lower() in lower and (t != t.lower() or lower.count(t) != text.count(t)) for t in self.raw):
                    text = lower
            own = _STOP.sub(r" \g<0>", text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            counts.append(len(own))
            numbers.append(np.fromiter(map(look, own), dtype=np.int64, count=len(own)))
        if self.words.fresh:
            self._add(self.words.fresh)
            self.words.fresh.clear()
        at = np.concatenate(numbers)
        return self.pieces.take(at), sums(self.pieces.lens[at], np.array(counts, dtype=np.int64))


@lru_cache(maxsize=2)
def cache_of(path: str) -> WordCache:
    return WordCache(path)


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray) -> bytes:
    """Ids in two bytes each, or four where one needs them, compressed: for the way between two steps only."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return _zstd()[0].compress(bytes([width]) + ids.astype(f"<u{width}").tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = _zstd()[1].decompress(data)
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and packed ids of every document, the end id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(tokenizer)
        for batch in batches:
            for part, texts in slices(batch):
                ids, lens = cache.encode(texts)
                at = starts_of(lens)
                packed = [pack(np.append(ids[a : a + n], np.uint32(end_id))) for a, n in zip(at, lens, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(lens + 1), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "packed"])

    return docs.select("doc_id", "text").mapInArrow(encode, IDS_SCHEMA)


def totals(texts: Iterable[np.ndarray], block: int = BLOCK) -> np.ndarray:
    """How often each id occurs in all texts; those of about `block` ids are counted at once, as each count is as long as the vocabulary."""
    total, held, size = np.zeros(0, dtype=np.int64), [], 0
    for own in chain(texts, [None]):
        if own is not None:
            held.append(own)
            size += len(own)
        if held and (own is None or size >= block):
            counts = np.bincount(np.concatenate(held))
            counts[: len(total)] += total[: len(counts)]
            total = np.concatenate([counts, total[len(counts) :]])
            held, size = [], 0
    return total


def counted(ids: DataFrame) -> DataFrame:
    """token_id, freq: how often each id occurs in all documents, scaled to 2**20. A row for each id that occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = totals(unpack(data.as_py()) for batch in batches for data in batch.column(0))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["token_id", "n"])

    counts = ids.select("packed").mapInArrow(count, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # a row for each id of the vocabulary at most
    freq = np.zeros(int(rows["token_id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    freq[rows["token_id"]] = rows["n"]
    freq = rans.scaled(freq)
    found = np.flatnonzero(freq)
    return ids.sparkSession.createDataFrame([(int(i), int(freq[i])) for i in found], "token_id int, freq long").coalesce(1)


def loaded(table_of: DataFrame) -> np.ndarray:
    rows = table_of.toPandas()  # as many rows as the vocabulary has ids at most
    freq = np.zeros(int(rows["token_id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    freq[rows["token_id"]] = rows["freq"]
    return freq


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, block: int = BLOCK, parts: int | None = None) -> None:
    """Tokenize docs (doc_id, text) and write the tables `table` and `blocks` below path."""
    spark = docs.sparkSession
    checked(tokenizer)
    stage = new_path(spark, "ids")
    tokenized(docs, tokenizer, end_id).write.option("compression", "none").parquet(stage)
    ids = spark.read.schema(IDS_SCHEMA).parquet(stage)
    counted(ids).write.parquet(f"{path}/table")
    freq = spark.sparkContext.broadcast(loaded(spark.read.parquet(f"{path}/table")))  # bounded by the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, before = rans.Table(freq.value), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, before
            all_ids = np.concatenate([x for _, x in held])
            b = rans.encode(all_ids, coder)
            row = [part, seq, before, np.array([d or 0 for d, _ in held], dtype="<i8").tobytes(), np.array([d is None for d, _ in held]).tobytes(), np.array([len(x) for _, x in held], dtype="<i8").tobytes(), b.n, b.states, b.offsets, b.words, b.words_crc32, b.ids_crc32]
            seq, before = seq + 1, before + b.n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)

        size = 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc_id, unpack(data.as_py())))
                size += len(held[-1][1])
                if size >= block:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    keys = ["doc_id", F.xxhash64("packed")]
    n = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order = ids.select("doc_id", "packed").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    in_order.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(spark, stage)


_BLOCK_NAMES = [x.split(" ")[0] for x in BLOCK_SCHEMA.split(", ")]
_BLOCK_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in BLOCK_SCHEMA.split(", ")]


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), ids (the same bytes; only if with_ids) of every document of the files at path."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    freq = spark.sparkContext.broadcast(loaded(spark.read.parquet(f"{path}/table")))  # bounded by the vocabulary
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each partition
    bases, total = {}, 0
    for part in sorted(totals):
        bases[part] = total
        total += totals[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Table(freq.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = rans.decode(rans.Block(row["n_tokens"], row["states"], row["offsets"], row["words"], row["words_crc32"], row["ids_crc32"]), coder)
                lens = np.frombuffer(row["doc_lens"], dtype="<i8")
                at = starts_of(lens)
                raw = [ids[a : a + n].astype("<u4").tobytes() for a, n in zip(at, lens, strict=True)]
                doc_ids = pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), pa.int64(), mask=np.frombuffer(row["doc_nulls"], dtype=bool))
                columns = [doc_ids, pa.array(bases[row["part"]] + row["part_start"] + at), pa.array(lens), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write(documents(spark, sf_dir, "doc_id", "text"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return read(spark, path, with_ids=False)
