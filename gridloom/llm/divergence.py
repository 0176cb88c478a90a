"""How a language's sources differ in their words, by systolic rotation.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those that are in LEAST_DOCS of its documents or more. A (lang, source) group
gives each of them p = 1 + floor(10**9 (count + 2) / (N + 2 V)), and so does the language as a whole; two such weights differ by floor((p - q)**2 / (p + q)).

Kept terms are numbered densely by language and dealt into blocks of `block`, so a group is a row for each block: the numbers of the terms it has, and their counts,
compressed. Groups play a round-robin tournament by the circle method: a group's blocks stay where they are, in a partition by (lang, place, block), and in each round those of its peer come to them. A meeting gives what both are apart,
for either direction, as a sum over the terms that one of them has and one product for all others; sums by block add up to the pair's. Beside that each block keeps a heap of its ten terms with
the greatest values over the language, and heaps are merged by group. `at_once` rounds are one job. No group, vocabulary or list of pairs is held whole: a task sees two blocks at a time.

All arithmetic is exact, up to 9 * 10**15 terms in a language. A null text, lang or source is ''. Groups without any term count as well, as do languages in which no term is kept: all values are 0 there. A language with one source has no pairs.
Repeated rows count each time. An empty table gives no rows; other columns are left out. The result has a row for each ordered pair of a language's sources, which is what is asked for, and so grows with the square of their number.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._shared import HOT, SLICE_CHARS, documents, dropped, released, slices, staged

#: Documents of its language that a term is in at least; the weights' unit; terms told of each group.
LEAST_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
#: Kept terms in a block, and rounds in a job.
BLOCK, AT_ONCE = 1 << 16, 16
#: Terms by group that a task counts at a time.
HELD = 500_000
_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS, _GAP = re.compile(_TERM).findall, re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); terms are counted in each document, then in each task, before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        counts: dict[tuple[str, str], dict[str, list[int]]] = {}
        held = 0
        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, text in enumerate(t for _, texts in slices(batch) for t in texts):
                group = counts.setdefault((langs[i], sources[i]), {})
                before = len(group)
                for term, n in of_text(text.encode().lower().decode()).items():  # of bytes only A-Z change
                    if (had := group.get(term)) is None:
                        group[term] = [n, 1]
                    else:
                        had[0] += n
                        had[1] += 1
                held += len(group) - before
                if held > HELD:  # the shuffle adds up what a task gives in several goes
                    yield from _flat(counts)
                    counts, held = {}, 0
        yield from _flat(counts)

    rows = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def of_text(text: str) -> Counter[str]:
    """Terms of a lower-cased text with how often they occur; a long one in parts that end between terms."""
    out: Counter[str] = Counter()
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + SLICE_CHARS) if len(text) - start > SLICE_CHARS else None
        end = gap.start() if gap else len(text)
        out.update(_TERMS(text, start, end))
        start = end
    return out


def _flat(counts: dict[tuple[str, str], dict[str, list[int]]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), terms in counts.items():
        n, docs = (pa.array([x[i] for x in terms.values()], pa.int64()) for i in (0, 1))
        names = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
        yield pa.RecordBatch.from_arrays([*names, pa.array(list(terms), pa.string()), n, docs], ["lang", "source", "term", "n", "docs"])


def _numbered(kept: DataFrame, block: int) -> DataFrame:
    """kept (lang, term, n) with block and id, dense in each block: terms are hashed to about the right number of blocks of their language, and numbered in these."""
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    dealt = kept.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / block)).cast("int"))
    dealt = dealt.repartition("lang", "block")  # not by language, as the join has it
    place = F.row_number().over(W.partitionBy("lang", "block").orderBy("term"))  # `block` terms, give or take
    return dealt.withColumn("id", (place - 1).cast("int")).drop("v")


def weights(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / total), by long division in base 1000, which needs no more than 64 bits."""
    left, out = counts + 2, np.zeros(len(counts), dtype=np.int64)
    if not total:
        return out
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); both are 10**9 + 1 at most."""
    return (p - q) ** 2 // (p + q)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed."""
    return zlib.compress(values.astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype="<i8")


def met(own: tuple[np.ndarray, np.ndarray, int], peer: tuple[np.ndarray, np.ndarray, int], terms: int) -> int:
    """What two blocks of `terms` terms are apart in sum; own and peer are ids (ascending), counts, and N + 2 V of their groups."""
    (a, n, total), (b, m, other) = own, peer
    ids = np.union1d(a, b)
    here, there = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    here[np.searchsorted(ids, a)] = n
    there[np.searchsorted(ids, b)] = m
    none = np.zeros(1, dtype=np.int64)
    rest = int(apart(weights(none, total), weights(none, other))[0]) * (terms - len(ids))
    return int(apart(weights(here, total), weights(there, other)).sum()) + rest


def _residents(rows: DataFrame) -> DataFrame:
    """lang, place, block, ids, counts of rows (lang, place, block, id, n), a row for each group and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, counts = None, [], []

        def row() -> Iterator[pa.RecordBatch]:
            if key is not None:
                values = [[key[0]], [key[1]], [key[2]], [packed(np.concatenate(ids))], [packed(np.concatenate(counts))]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "place", "block", "ids", "counts"])

        for batch in batches:
            table = [batch.column(i) for i in range(3)]
            all_ids, all_counts = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            # where another group's or block's rows begin
            places, blocks = (c.to_numpy() for c in table[1:])
            langs = table[0].dictionary_encode().indices.to_numpy()
            new = np.flatnonzero((np.diff(langs) != 0) | (np.diff(places) != 0) | (np.diff(blocks) != 0)) + 1 if len(langs) else []
            for start, end in zip([0, *new], [*new, len(langs)], strict=True):
                if start == end:
                    continue
                here = tuple(c[int(start)].as_py() for c in table)
                if here != key:
                    yield from row()
                    key, ids, counts = here, [], []
                ids.append(all_ids[start:end])
                counts.append(all_counts[start:end])
        yield from row()

    dealt = rows.select("lang", "place", "block", "id", "n").repartition("lang", "place", "block").sortWithinPartitions("lang", "place", "block", "id")
    return dealt.mapInArrow(run, "lang string, place int, block int, ids binary, counts binary")


def _rotated(residents: DataFrame, most: int, at_once: int) -> Iterator[DataFrame]:
    """lang, place, peer, value of each meeting's block, a table for each job of `at_once` rounds.

    residents: lang, place, block, ids, counts, total (N + 2 V), players (of the language), terms (of the block). With an odd number of players one has no peer in each round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            last, own = None, None  # a group meets several peers in a row
            for r in (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*batch.columns, strict=True)):
                key = tuple(r[c].as_py() for c in ("lang", "place", "block"))
                if key != last:
                    last, own = key, (unpacked(r["ids"].as_py()), unpacked(r["counts"].as_py()), r["total"].as_py())
                peer = (unpacked(r["peer_ids"].as_py()), unpacked(r["peer_counts"].as_py()), r["peer_total"].as_py())
                value = met(own, peer, r["terms"].as_py())
                rows += [(key[0], key[1], r["peer"].as_py(), value), (key[0], r["peer"].as_py(), key[1], value)]  # either direction
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["lang", "place", "peer", "value"])

    even = F.col("players") + F.col("players") % 2
    for first in range(0, most, at_once):
        # in round r, of n (even) players, i meets 2 r - i modulo n - 1, and who would meet itself meets the last; the higher number travels
        rounds = F.explode(F.sequence(F.lit(first), F.lit(min(first + at_once, most) - 1))).alias("r")
        going = residents.select("lang", "place", "block", F.col("ids").alias("peer_ids"), F.col("counts").alias("peer_counts"), F.col("total").alias("peer_total"), even.alias("even"), rounds).filter("r < even - 1")
        at = F.when(F.col("place") == F.col("even") - 1, F.col("r")).otherwise(F.pmod(2 * F.col("r") - F.col("place"), F.col("even") - 1))
        going = going.withColumn("host", at.cast("int")).filter("host < place").select("lang", F.col("host").alias("place"), "block", F.col("place").alias("peer"), "peer_ids", "peer_counts", "peer_total")
        meetings = residents.join(going, ["lang", "place", "block"])
        yield meetings.select("lang", "place", "block", "ids", "counts", "total", "terms", "peer", "peer_ids", "peer_counts", "peer_total").mapInArrow(run, "lang string, place int, peer int, value long")


def _told(rows: DataFrame, top: int) -> DataFrame:
    """Of rows (lang, place, term, n, total, all_n, all_total) the `top` terms of each group by how much more of them it has than its language: a heap for each group in a task, then one of what these give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for batch in batches:
            names = batch.schema.names
            n, total, all_n, all_total = (batch.column(names.index(c)).to_numpy().astype(np.int64) for c in ("n", "total", "all_n", "all_total"))
            p, q = np.empty_like(n), np.empty_like(n)
            for counts, totals, out in ((n, total, p), (all_n, all_total, q)):
                for t in np.unique(totals):
                    out[totals == t] = weights(counts[totals == t], int(t))
            more = np.flatnonzero(p > q)
            value = apart(p[more], q[more])
            own = batch.select(["lang", "place", "term"]).take(pa.array(more))
            for lang, place, term, v in zip(*(c.to_pylist() for c in own.columns), value.tolist(), strict=True):
                heap = heaps.setdefault((lang, place), [])
                item = (v, _Last(term))
                if len(heap) < top:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(heaps) > 100_000:  # however many groups a task meets
                yield _heaped(heaps)
                heaps = {}
        yield _heaped(heaps)

    best = rows.mapInArrow(run, "lang string, place int, term string, value long")
    place = F.row_number().over(W.partitionBy("lang", "place").orderBy(F.desc("value"), "term"))
    return best.withColumn("rank", place).filter(F.col("rank") <= top)


class _Last(str):
    """A text that is greater the earlier it sorts."""

    __slots__ = ()

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)

    def __gt__(self, other: str) -> bool:
        return str.__lt__(self, other)


def _heaped(heaps: dict[tuple[str, int], list[tuple[int, str]]]) -> pa.RecordBatch:
    rows = [(lang, place, str(term), v) for (lang, place), heap in heaps.items() for v, term in heap]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "place", "term", "value"])


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """lang, source, part, item, value, rank from docs (text, lang, source): `pair`, all other sources of the language by how far they are; `term`, the terms that a source has
    most more of than its language."""
    spark = docs.sparkSession
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = named.select("lang", "source").distinct()
    (counts, counts_path) = staged(counted(named), "counts")
    seen = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    (kept, kept_path) = staged(_numbered(seen.select("lang", "term", "n"), block), "kept")
    # a row of counts for each kept term and group
    terms, terms_path = staged(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term", "block", "id", F.col("n").alias("all_n")), ["lang", "term"]), "terms")
    dropped(spark, counts_path)

    langs = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("v"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    sized = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    v2 = 2 * F.coalesce("v", F.lit(0))
    sized = sized.select("lang", "source", (F.coalesce("own", F.lit(0)) + v2).alias("total"), (F.coalesce("all", F.lit(0)) + v2).alias("all_total"), F.coalesce("v", F.lit(0)).alias("v"))
    by_lang = W.partitionBy("lang")  # sources, of whose pairs there is a row each in the result
    sized = sized.withColumns({"place": (F.row_number().over(by_lang.orderBy("source")) - 1).cast("int"), "players": F.count("*").over(by_lang).cast("int")})
    sized, sized_path = staged(sized, "groups")
    most = sized.agg(F.max(F.col("players") + F.col("players") % 2 - 1)).first()[0] or 0

    placed = _with_group(terms, sized)
    told = _told(placed.select("lang", "place", "term", "n", "total", "all_n", "all_total"), top)
    name = sized.select("lang", "place", "source")
    out_terms, _ = staged(told.join(name, ["lang", "place"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"), "told")

    blocks = kept.groupBy("lang", "block").agg(F.count("*").cast("int").alias("terms"))
    vectors = _residents(placed)
    # every group has every block, those of which it has no term too
    empty = packed(np.zeros(0))
    grid = sized.select("lang", "place", "total", "players").join(blocks, "lang").join(vectors, ["lang", "place", "block"], "left")
    grid, grid_path = staged(grid.select("lang", "place", "block", "total", "players", "terms", *[F.coalesce(c, F.lit(empty)).alias(c) for c in ("ids", "counts")]), "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    residents = grid.repartition(parts, "lang", "place", "block").sortWithinPartitions("lang", "place", "block").persist(StorageLevel.DISK_ONLY)
    sums: DataFrame | None = None
    for meetings in _rotated(residents, most, at_once):
        own, _ = staged(meetings.groupBy("lang", "place", "peer").agg(F.sum("value").alias("value")), "meetings")
        sums = own if sums is None else sums.unionByName(own)
    residents.unpersist()
    # where no term is kept nobody meets, and all are 0 apart
    pairs = sized.filter("v = 0").select("lang", "place").join(sized.select("lang", F.col("place").alias("peer")), "lang").filter("place <> peer").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs if sums is None else pairs.unionByName(sums)
    peer = name.select("lang", F.col("place").alias("peer"), F.col("source").alias("item"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))  # as many as the language has sources
    out_pairs = pairs.join(name, ["lang", "place"]).join(peer, ["lang", "peer"]).withColumn("rank", rank)
    out, _ = staged(out_pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(out_terms), "audit")
    for path in (kept_path, terms_path, sized_path, grid_path):
        dropped(spark, path)
    return out


def _with_group(terms: DataFrame, sized: DataFrame) -> DataFrame:
    """terms with place, total and all_total of their groups, of which few may hold most terms."""
    counts = terms.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    hot = F.broadcast(counts.filter(F.col("_n") * HOT > terms.count()).select("lang", "source"))  # less than HOT rows
    own = sized.select("lang", "source", "place", "total", "all_total")
    keys = ["lang", "source"]
    return terms.join(F.broadcast(own.join(hot, keys, "left_semi")), keys).unionByName(terms.join(hot, keys, "left_anti").join(own, keys))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(documents(spark, sf_dir, "text", "lang", "source"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST_DOCS}),
langs AS (SELECT l.lang, coalesce(sum(n), 0) AS n, count(term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept USING (lang) GROUP BY l.lang),
own AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN own ON own.lang = g.lang AND own.source = g.source GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + CAST({UNIT} * (coalesce(o.c, 0) + 2)::HUGEINT // (g.n + 2 * l.v) AS BIGINT) AS p, 1 + CAST({UNIT} * (k.n + 2)::HUGEINT // (l.n + 2 * l.v) AS BIGINT) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
tops AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM tops QUALIFY rank <= {TOP}"""
