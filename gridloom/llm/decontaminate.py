"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Texts are lower-case words (runs of letters, digits and underscores). The runs of `least` words of all test items are a table of seeds, by hash.
Documents' runs that a bit table of the seeds lets pass are joined to it, and what a text and an item share is gathered: the places of each shared run
in both. From these alone the text is tiled against the item: the longest match of words not yet marked is marked, again and
again, until none of `least` words is left. Tiles may stand in any order, so a reordered passage counts as a straight one does. An item that is covered to `threshold` leaks.

The bit table has a fixed size at most, so it is sent to all tasks however many items there are; with more of them more runs pass, and the join is exact.
An item is first met by its rare seeds alone, so a phrase that many items share joins no text to them; all that a text and an item share is gathered for those that meet so. Seeds that a passage has brought to a large part of all texts find their items in a table that all tasks are sent. Equal texts are one, known by their MD5; a document's row is met again by it at the end,
where Spark sends the leaking texts' keys to all tasks if they are small and shuffles otherwise. Texts that share nothing with an item never move.
Runs are told apart by 64 bits. What one text shares with one item meets in a row, which has the bound of the two texts' lengths.

Null and empty texts and items of fewer than `least` words match nothing. Repeated items each match. Null doc_ids, repeated rows and other columns
stay, whatever their names; a column named `leaks` is replaced. item_id may have any type that can be ordered. An empty table of either kind gives no leaks.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._shared import documents, dropped, met, released, slices, staged, starts_of, table, unused

LEAST, THRESHOLD = 5, 0.5
#: Bits of the table of seeds: 64 for each seed, and these at least and at most (8 MB), as powers of two.
FEWEST_BITS, MOST_BITS = 16, 26
#: Bits in one group of the table.
GROUP = 1 << 15
#: Words that a task keeps with their hashes.
CACHED = 500_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_words = re.compile(r"\w+").findall

TILES = "array<struct<doc_at:int,item_at:int,n:int>>"
_TILES = pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("n", pa.int32())]))


class _Hashes(dict):
    """Words' hashes."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Running:
    """Hashes of all runs of a sequence, of any length, from one running sum."""

    def __init__(self, values: np.ndarray) -> None:
        self.sum = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values.astype(np.uint64) * _powers(_BASE, len(values)), out=self.sum[1:])
        self.back = _powers(_BACK, len(values) + 1)

    def at(self, starts: np.ndarray, n: int) -> np.ndarray:
        """The hashes of the runs of n that begin at starts: the sum over a run, brought back to the sequence's begin."""
        return (self.sum[starts + n] - self.sum[starts]) * self.back[starts]


class _Side:
    """The shared runs of one text in order: runs at neighbouring places stand in neighbouring slots, others are parted by an empty one."""

    def __init__(self, places: np.ndarray, symbols: np.ndarray, least: int) -> None:
        order = np.argsort(places, kind="stable")
        places, symbols = places[order], symbols[order]
        slots = np.arange(len(places)) + np.concatenate([[0], np.cumsum(np.diff(places) > 1)]).astype(np.int64)[: len(places)]
        size = int(slots[-1]) + 1 if len(slots) else 0
        self.symbols, self.live, self.least = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=bool), least
        self.symbols[slots], self.live[slots] = symbols, True
        self.places = np.zeros(size, dtype=np.int64)
        self.places[slots] = places
        self.places = np.maximum.accumulate(self.places)  # an empty slot counts with the one before
        self.running = Running((self.symbols + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0xA5A5A5A5))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots where n live ones begin, and the hashes of these."""
        live = np.concatenate([[0], np.cumsum(self.live)])
        starts = np.flatnonzero(live[n:] - live[:-n] == n)
        return starts, self.running.at(starts, n)

    def mark(self, place: int, words: int) -> None:
        """No run that holds one of these words is live any more."""
        a, b = np.searchsorted(self.places, [place - self.least + 1, place + words], "left")
        self.live[a:b] = False


def tiled(doc: _Side, item: _Side) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, words) of the tiles, longest first."""
    out: list[tuple[int, int, int]] = []
    least, most = doc.least, min(len(doc.places), len(item.places))
    while most > 0:
        # the longest match: where n shared runs in a row agree, fewer do too
        low, high = 0, most
        while low < high:
            n = high if (low, high) == (0, most) else (low + high + 1) // 2  # a whole copy is found at once
            low, high = (n, high) if np.isin(item.runs(n)[1], doc.runs(n)[1]).any() else (low, n - 1)
        if not low:
            break
        words, free, marked = low + least - 1, -1, len(out)
        places: dict[int, deque[int]] = {}
        for q, h in zip(*(x.tolist() for x in item.runs(low)), strict=True):
            places.setdefault(h, deque()).append(q)
        starts, hashed = doc.runs(low)
        hit = np.isin(hashed, np.fromiter(places, dtype=np.uint64, count=len(places)))
        for p, h in zip(starts[hit].tolist(), hashed[hit].tolist(), strict=True):
            if doc.places[p] < free:
                continue
            own = places[h]
            while own and not item.live[own[0] : own[0] + low].all():
                own.popleft()
            if own and (doc.symbols[p : p + low] == item.symbols[own[0] : own[0] + low]).all():
                at, to = int(doc.places[p]), int(item.places[own[0]])
                out.append((at, to, words))
                doc.mark(at, words)
                item.mark(to, words)
                free = at + words
                if not len(item.runs(low)[0]):
                    break
        most = low if len(out) > marked else low - 1
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The tiles of two sequences of ids. Negative ids match nothing."""
    sides = []
    for ids in (doc, item):
        bad = np.concatenate([[0], np.cumsum(ids < 0)])
        starts = np.flatnonzero(bad[least:] == bad[:-least]) if len(ids) >= least else np.zeros(0, dtype=np.int64)
        sides.append((starts, Running((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)).at(starts, least)))
    shared = np.intersect1d(sides[0][1], sides[1][1])
    kept = [(at[np.isin(h, shared)], np.searchsorted(shared, h[np.isin(h, shared)])) for at, h in sides]
    return tiled(*(_Side(at, symbols, least) for at, symbols in kept))


def runs_of(texts: list[str], least: int, known: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of `least` words: the text's number, the place in it, the hash; then the number of words of each text."""
    if len(known) > CACHED:
        known.clear()
    words = [_words(t.lower()) for t in texts]
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(lens.sum()))
    counts = np.maximum(lens - least + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    places = np.arange(len(owner)) - np.repeat(starts_of(counts), counts)
    return owner, places, Running(flat).at(np.repeat(starts_of(lens), counts) + places, least), lens


def _by_seed(places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, where each one's places begin in the third array, and the places."""
    order = np.argsort(hashes, kind="stable")
    found, first = np.unique(hashes[order], return_index=True)
    return found, first, places[order]


def _lists(starts: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32)))


def _seeds_of_items(benchmark: DataFrame, least: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """item_id, item of every item of `least` words or more; and seed, item, item_words, item_at (its places), rare of every distinct word sequence, `item`.

    To cover an item to the threshold takes k places at least, where k tiles of `least` words are that many words. So of its places all but any k - 1 hold a shared one: these are its `rare` seeds, and the k - 1 left out are those that most items have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for part, texts in slices(batch):
                owner, places, hashes, lens = runs_of(texts, least, known)
                at = np.searchsorted(owner, np.arange(len(texts) + 1))
                for i in np.flatnonzero(lens >= least).tolist():
                    found, first, own = _by_seed(places[at[i] : at[i + 1]], hashes[at[i] : at[i + 1]])
                    key = hashlib.md5(" ".join(_words(texts[i].lower())).encode("utf-8", "surrogatepass")).digest()
                    lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.StructArray.from_arrays([pa.array(found.view(np.int64)), _lists(first, own)], ["seed", "at"]))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, 1), pa.array([key], pa.binary()), pa.array(lens[i : i + 1].astype(np.int32)), lists], ["item_id", "item", "item_words", "seeds"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    read = benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, item binary, item_words int, seeds array<struct<seed:bigint,at:array<int>>>")
    read, _ = staged(read, "items")
    once = read.groupBy("item").agg(F.any_value("item_words").alias("item_words"), F.any_value("seeds").alias("seeds"))
    seeds, path = staged(once.select("item", "item_words", F.explode("seeds").alias("s")).select("s.seed", "item", "item_words", F.col("s.at").alias("item_at")), "seeds")
    often = seeds.groupBy("seed").agg(F.count("*").alias("often"))
    upto = F.sum(F.size("item_at")).over(W.partitionBy("item").orderBy(F.desc("often"), "seed").rowsBetween(W.unboundedPreceding, 0))  # the words of an item
    spare = F.ceil(threshold * F.col("item_words") / least - 1e-9) - 1
    ranked, _ = staged(met(seeds, often, "seed").select(*seeds.columns, (upto > spare).alias("rare")), "ranked")
    dropped(benchmark.sparkSession, path)
    return read.select("item_id", "item"), ranked


def bit_table(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each seed's first `bits` bits, as bytes; and `bits`."""
    bits = min(max((64 * seeds.count()).bit_length(), FEWEST_BITS), MOST_BITS)
    slot = F.shiftrightunsigned("seed", 64 - bits)
    rows = seeds.groupBy(F.shiftright(slot, GROUP.bit_length() - 1).alias("k")).agg(F.bitmap_construct_agg(slot.bitwiseAND(GROUP - 1)).alias("b")).collect()  # 8 MB in all at most
    out = np.zeros((1 << bits) // GROUP * GROUP // 8, dtype=np.uint8)
    for r in rows:
        out[r["k"] * GROUP // 8 : (r["k"] + 1) * GROUP // 8] = np.frombuffer(r["b"], dtype=np.uint8)
    return out, bits


def _key(text: str) -> Column:
    return F.unhex(F.md5(text))


def _candidates(docs: DataFrame, seeds: DataFrame, least: int) -> DataFrame:
    """key, seed, at (its places) of the runs of texts that the bit table lets pass."""
    bits_of, bits = bit_table(seeds)
    sent = docs.sparkSession.sparkContext.broadcast(bits_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        known, probe, shift = _Hashes(), sent.value, np.uint64(64 - bits)
        for batch in batches:
            for _, texts in slices(batch):
                owner, places, hashes, _ = runs_of(texts, least, known)
                slot = hashes >> shift
                hit = np.flatnonzero(probe[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                owner, places, hashes = owner[hit], places[hit], hashes[hit]
                for i in np.unique(owner).tolist():
                    a, b = np.searchsorted(owner, [i, i + 1])
                    found, first, own = _by_seed(places[a:b], hashes[a:b])
                    key = hashlib.md5(texts[i].encode()).digest()
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.binary()), pa.array(found.view(np.int64)), _lists(first, own)], ["key", "seed", "at"])

    found = docs.select("text").mapInArrow(run, "key binary, seed long, at array<int>")
    return found.groupBy("key", "seed").agg(F.any_value("at").alias("at"))  # equal texts are one


def candidates(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """key, item of the texts and items that share a rare seed, once each; only these can be covered."""
    return met(found.select("key", "seed"), seeds.filter("rare").select("seed", "item"), "seed").select("key", "item").distinct()


def _tile(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Tiles for rows of key, item, item_words, runs (at, item_at)."""
    for batch in batches:
        runs = batch.column(3)
        ends = np.concatenate([[0], np.cumsum(np.asarray(runs.value_lengths()))]).astype(np.int64)
        sides = []
        for lists in runs.flatten().flatten():
            lens = np.asarray(lists.value_lengths()).astype(np.int64)
            sides.append((np.concatenate([[0], np.cumsum(lens)]), lens, lists.flatten().to_numpy().astype(np.int64)))
        found = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            doc, item = (_Side(flat[at[a] : at[b]], np.repeat(np.arange(b - a), lens[a:b]), least) for at, lens, flat in sides)
            found.append(tiled(doc, item))
        covered = pa.array([sum(n for _, _, n in x) for x in found], pa.int32())
        told = pa.array([[{"doc_at": p, "item_at": q, "n": n} for p, q, n in x] for x in found], _TILES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], covered, told], ["key", "item", "item_words", "covered", "tiles"])


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """key (of a text), item_id, item_words, covered, coverage, tiles: a row for each distinct text and item that it covers."""
    items, seeds = _seeds_of_items(benchmark, least, threshold)
    found, found_path = staged(_candidates(docs, seeds, least), "runs")
    asked, asked_path = staged(candidates(found, seeds), "candidates")
    shared = asked.join(found, "key").join(seeds.drop("rare"), ["seed", "item"])
    both = shared.groupBy("key", "item", "item_words").agg(F.collect_list(F.struct("at", "item_at")).alias("runs"))  # a text and an item
    # k words in tiles of `least` or more take k / least shared runs at least
    both = both.filter(least * F.aggregate("runs", F.lit(0), lambda n, r: n + F.size(r["item_at"])) >= threshold * F.col("item_words"))
    made = both.mapInArrow(lambda batches: _tile(batches, least), f"key binary, item binary, item_words int, covered int, tiles {TILES}")
    made = made.filter(F.col("covered") >= threshold * F.col("item_words")).join(items, "item")
    out, _ = staged(made.select("key", "item_id", "item_words", "covered", (F.col("covered") / F.col("item_words")).alias("coverage"), "tiles"), "leaks")
    dropped(docs.sparkSession, found_path)
    dropped(docs.sparkSession, asked_path)
    return out


def annotated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a column `leaks`: the items of benchmark (item_id, text) that each row covers, with the tiles."""
    docs = docs.drop("leaks")
    key = unused(docs, "key")
    one = leaks(docs, benchmark, least, threshold).groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("item_id", "item_words", "covered", "coverage", "tiles"))).alias("leaks"))  # the items that one text covers
    out = docs.withColumn(key, _key("text")).join(one, key, "left")
    return out.select(*docs.columns, F.coalesce("leaks", F.array().cast(one.schema["leaks"].dataType)).alias("leaks"))


def op2_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each leak: a document and a test item that it covers."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = docs.select("doc_id", _key("text").alias("key")).join(leaks(docs, table(spark, sf_dir, "benchmark")), "key")
    return found.select("doc_id", "item_id", "item_words", "covered", "coverage", F.size("tiles").alias("n_tiles"), F.lit(True).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that leak."""
    key = unused(docs, "key")
    bad, _ = staged(leaks(docs, benchmark, least, threshold).select(F.col("key").alias(key)).distinct(), "leaking")
    return docs.withColumn(key, _key("text")).join(bad, key, "left_anti").select(*docs.columns)
