"""Byte-level BPE encoding and decoding by merge rounds over flat numpy arrays.

The symbols of many words stand in one array. A round looks up, for every adjacent pair that is
new, its rank by binary search over the sorted pair keys, takes each word's lowest rank, and
merges all places of that pair in the word, left to right. Words without a known pair leave the
array, so late rounds are short. Words are encoded once for each task's cache.

`encoded` gives doc_id, n_tokens, ids for doc_id, text; `decoded` gives the texts for the ids; `round_trip` gives both in one
pass, so that a task has one Python worker with one vocabulary at a time. The ids are those of the tokenizers library with
add_special_tokens=False; decoding is that of its decode(ids, skip_special_tokens=False).

Null texts are empty: no ids, and an empty text back. Repeated rows and null doc_ids stay as they
are, an empty table gives no rows, and other columns are only kept where `carry` names them. Whole texts are encoded, however
long; a text without spaces is one long word, which takes as many rounds as it has distinct merges.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import Pieces, Words, documents, flattened, gather, released, slices, starts_of, sums
from gridloom.llm.token_store import tokenizer_file

#: White space as Unicode has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a byte-level tokenizer cuts texts into before the merges (fixed by the vocabulary file's kind).
_CUT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_NEVER = np.int64(1 << 40)
CACHED = 100_000
#: Characters whose words and ids are held at a time.
PART_CHARS = 300_000


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class ByteBpe:
    """A vocabulary file's merges and byte strings, ready for numpy."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.cached = cached
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.of_byte = np.array([vocab[c] for c in chars], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.width = max(max(vocab.values()), *self.special.values(), 0) + 1
        keys = left * self.width + right
        self.rank_at = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.rank_at], made
        own = {c: b for b, c in enumerate(chars)}
        strings = [b""] * self.width
        for token, i in [*vocab.items(), *self.special.items()]:
            strings[i] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
        self.bytes = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.bytes_len = np.fromiter(map(len, strings), dtype=np.int64, count=self.width)
        self.bytes_at = starts_of(self.bytes_len)
        self.words, self.pieces = Words(), Pieces()

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair key, by binary search."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank_at[at], _NEVER)

    def merged(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given as bytes' ids, and how many each word has. No word may be empty."""
        word = np.arange(len(lens))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = starts_of(lens)
        rank = np.full(len(symbols), _NEVER)
        if len(symbols) > 1:
            rank[:-1] = self.ranks(symbols[:-1] * self.width + symbols[1:])
            rank[starts + lens - 1] = _NEVER
        while len(lens):
            low = np.minimum.reduceat(rank, starts)
            alive = low < _NEVER
            if not alive.all():
                of_alive = np.repeat(alive, lens)
                done.append((word[~alive], lens[~alive], symbols[~of_alive]))
                word, lens, low, symbols, rank = word[alive], lens[alive], low[alive], symbols[of_alive], rank[of_alive]
                starts = starts_of(lens)
                if not len(lens):
                    break
            hit = rank == np.repeat(low, lens)
            if (hit[1:] & hit[:-1]).any():  # in a run such as "aaaa", every other pair
                at = np.arange(len(hit))
                first = hit.copy()
                first[1:] &= ~hit[:-1]
                hit &= (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
            symbols[hit] = self.made[rank[hit]]
            stays = np.ones(len(hit), dtype=bool)
            stays[1:] = ~hit[:-1]
            lens = lens - np.add.reduceat(hit, starts, dtype=np.int64)
            symbols, rank, at = symbols[stays], rank[stays], np.flatnonzero(hit[stays])
            starts = starts_of(lens)
            last = np.zeros(len(symbols) + 1, dtype=bool)
            last[starts + lens - 1] = last[-1] = True
            new = np.concatenate([at, at[at > 0] - 1])
            rank[new[last[new]]] = _NEVER
            new = new[~last[new]]
            rank[new] = self.ranks(symbols[new] * self.width + symbols[new + 1])
        if not done:
            return symbols, lens
        words, own, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")
        return gather(flat, starts_of(own)[order], own[order]), own[order]

    def _add(self, words: list[str]) -> None:
        plain = [w for w in words if w not in self.special]
        raw = [w.encode("utf-8", "surrogatepass") for w in plain]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ids, own = self.merged(self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)], lens)
        if len(plain) == len(words):
            self.pieces.add(ids, own)
            return
        runs = iter(np.split(ids, np.cumsum(own)[:-1]))
        self.pieces.add(*flattened([[self.special[w]] if w in self.special else next(runs).tolist() for w in words]))

    def cut(self, text: str) -> list[str]:
        if self.special_cut and any(s in text for s in self.special):
            return [w for i, part in enumerate(self.special_cut.split(text)) for w in ([part] if i % 2 else _CUT.findall(part))]
        return _CUT.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if len(self.words) > self.cached:
            self.words, self.pieces = Words(), Pieces()
        numbers, counts, look = [np.zeros(0, dtype=np.int64)], [], self.words.__getitem__
        for text in texts:
            own = self.cut(text)
            counts.append(len(own))
            numbers.append(np.fromiter(map(look, own), dtype=np.int64, count=len(own)))
        if self.words.fresh:
            self._add(self.words.fresh)
            self.words.fresh.clear()
        at = np.concatenate(numbers)
        return self.pieces.take(at), sums(self.pieces.lens[at], np.array(counts, dtype=np.int64))

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """The texts of consecutive runs of ids; ids that the vocabulary lacks are left out, broken UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        known = (ids >= 0) & (ids < self.width)
        ids = np.where(known, ids, 0)
        own = np.where(known, self.bytes_len[ids], 0)
        raw = gather(self.bytes, self.bytes_at[ids], own).tobytes()
        ends = np.cumsum(sums(own, lens)).tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def bpe_of(path: str) -> ByteBpe:
    return ByteBpe(path)


def coder(path: str, back: bool, carry: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of doc_id, text and the columns named by carry: doc_id, n_tokens, ids, with `back` the text that these ids decode to, and those columns."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        bpe = bpe_of(path)
        for batch in batches:
            for part, texts in slices(batch, limit=PART_CHARS):
                ids, lens = bpe.encode(texts)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                again = [pa.array(bpe.decode(ids, lens), pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lens), column, *again, *part.columns[2:]], ["doc_id", "n_tokens", "ids", *["text"] * back, *carry])
        released()  # the worker stays while other stages run

    return code


def _coded(docs: DataFrame, path: str, back: bool, carry: tuple[str, ...]) -> DataFrame:
    more = ", text string" * back + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *carry).mapInArrow(coder(path, back, carry), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>{more}")


def encoded(docs: DataFrame, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens long, ids array<int>, and the columns named by carry, of every row of docs."""
    return _coded(docs, path, False, carry)


def round_trip(docs: DataFrame, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens long, ids array<int>, text string (what these ids decode to), and the columns named by carry, of every row of docs."""
    return _coded(docs, path, True, carry)


def decoded(ids: DataFrame, path: str, carry: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """doc_id, text, the columns named by carry and, if asked for, ids, of every row of ids (doc_id, ids array<int>). Null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(1)
                lens = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
                texts = bpe.decode(np.asarray(column.flatten().fill_null(-1)), lens)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *part.columns[2:], *[column] * with_ids], ["doc_id", "text", *carry, *["ids"] * with_ids])

    more = "".join(f", `{c}` {ids.schema[c].dataType.simpleString()}" for c in carry) + ", ids array<int>" * with_ids
    return ids.select("doc_id", "ids", *carry).mapInArrow(decode, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string{more}")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, if asked for ids, ids_sha256, decoded_sha256: every text there and back."""
    ids_sha256 = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256")
    return round_trip(docs, path).select("doc_id", "n_tokens", *["ids"] * with_ids, ids_sha256, F.sha2("text", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
