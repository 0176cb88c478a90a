import itertools
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, resemblance, simhash
from gridloom.llm.components import components

from .helpers import docs, wide


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in own}


def test_fingerprints():
    texts = ["", " \n", "one", "One TWO", "a b c a b c a b c", "É é x y z w", "the quick brown fox " * 500]
    assert [int(x) for x in simhash.fingerprint(texts)] == [brute_print(t) for t in texts]


def ball(seed, n):
    rng = random.Random(seed)
    base, out = rng.getrandbits(64), [rng.getrandbits(64) for _ in range(60)]
    for _ in range(n):
        x = base
        for b in rng.sample(range(64), rng.randrange(5)):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("most", [2, 64])
def test_links_lose_nothing(spark, most):
    prints = ball(7, 400)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": np.array(prints, dtype=np.uint64).view(np.int64)}))
    got = {r["node"] & (1 << 64) - 1: r["root"] for r in components(simhash.links(nodes, most)).collect()}
    ours, theirs = {}, {}
    for x, r in brute_groups(prints).items():
        ours.setdefault(got.get(x, ("alone", x)), set()).add(x)
        theirs.setdefault(r, set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(i, 0) for i in range(n + 1)} | {(200, 200), (201, 200)}
    assert components(links.limit(0)).count() == 0


def test_grouped_and_deduplicated(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(7, long), (3, long), (3, long), (9, "alone here today again"), (4, None), (5, ""), (None, "no name for this one"), (None, long)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.grouped(wide(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (3, 3), (9, 9), (4, 4), (5, 4), (None, None), (None, 3)], key=str)
    kept = simhash.deduplicated(wide(spark, rows))
    assert kept.columns == wide(spark, rows).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 9, 4, None], key=str)  # a copy without an id goes like any other
    assert simhash.grouped(docs(spark, [])).count() == simhash.deduplicated(docs(spark, [])).count() == 0


def runs_of_five(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard_groups(texts):
    """Components of texts at 0.8 or more, by all pairs."""
    own, root = [runs_of_five(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(own):
        for j in range(i):
            if 9 * len(x & own[j]) >= 4 * (len(x) + len(own[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("most", [2, 64])
def test_near_copies_at_four_fifths(spark, most):
    rng, texts = random.Random(5), []
    passage = [f"common{i}" for i in range(30)]
    for k in range(12):
        base = [f"w{k}x{i}" for i in range(100)] + passage
        for edits in range(8):
            words = list(base)
            for at in rng.sample(range(100), edits):
                words[at] = f"new{rng.random()}"
            texts.append(" ".join(words))
    texts += [" ".join([*passage, *(f"own{k}y{i}" for i in range(n))]) for k in range(30) for n in [rng.randrange(2, 20)]]
    texts += ["one two three", "One two  three", "one two four"]
    want = jaccard_groups(texts)
    kept = simhash.deduplicated(docs(spark, list(enumerate(texts))), most)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert 12 < len(set(want)) < len(texts) - 12


def test_bands_hold_near_copies():
    """Of pairs at 0.8 or little more, all but a few in ten thousand agree in a band."""
    rng, missed, n = np.random.default_rng(3), 0, 4000
    for _ in range(n):
        both = rng.integers(-(2**31), 2**31, 80)
        one, other = (np.unique(np.concatenate([both, rng.integers(-(2**31), 2**31, 10)])).astype(np.int32).view(np.uint32).astype(np.uint64) for _ in range(2))
        least = [(x[None, None, :] * resemblance.FACTORS[:, :, None] >> np.uint64(32)).min(axis=2) for x in (one, other)]
        missed += not (least[0] == least[1]).all(axis=1).any()
    assert missed <= 5


def test_sketches_decide_as_whole_sets_do():
    """Pairs of all similarities: what sketches are sure of is right, and near 0.8 they are not sure."""
    rng, unsure = np.random.default_rng(5), {}
    for shared in [*range(300, 1000, 10)] * 3:
        own = 1000 - shared
        both, rest = rng.integers(0, 1 << 32, shared, dtype=np.uint64), rng.integers(0, 1 << 32, (2, own // 2), dtype=np.uint64)
        pair = [np.unique(np.concatenate([both, r])) for r in rest]
        similarity = len(np.intersect1d(*pair)) / len(np.union1d(*pair))
        one, other = (resemblance._sketch(x, np.zeros(1, dtype=np.int64))[0] for x in pair)
        apart = int(np.bitwise_count((one ^ other).view(np.uint64)).sum())
        assert apart > resemblance.SURE or similarity >= 0.8
        assert apart <= resemblance.NEVER or similarity < 0.8
        unsure.setdefault(round(similarity, 1), []).append(resemblance.SURE < apart <= resemblance.NEVER)
    assert all(unsure[0.8]) or sum(unsure[0.8]) > 0.8 * len(unsure[0.8])
    assert not any(unsure[0.5]) and not any(unsure[1.0][-5:])


def test_rows_without_an_id(spark):
    """Copies without a doc_id come down to one, which goes too if a copy has an id."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(50))
    rows = [(None, text("a")), (None, text("a")), (None, text("a") + " more"), (None, text("b")), (5, text("b")), (None, text("c")), (None, None), (None, "")]
    kept = simhash.deduplicated(wide(spark, rows)).collect()
    assert sorted(((r["doc_id"], (r["text"] or "")[:1]) for r in kept), key=str) == sorted([(None, "a"), (5, "b"), (None, "c"), (None, "")], key=str)


def test_families_whose_members_are_near_few_others(spark, monkeypatch):
    """A chain of texts, each near the next ones, in few large groups: leaders in turn, and none."""
    rng, texts = random.Random(11), []
    words = [f"w{i}" for i in range(150)]
    for k in range(90):
        texts.append(" ".join(words))
        words[rng.randrange(0, 150, 5)] = f"new{k}"
    want = sorted(set(jaccard_groups(texts)))
    for linear in (0.0, 1e9):
        monkeypatch.setattr(resemblance, "LINEAR", linear)
        kept = simhash.deduplicated(docs(spark, list(enumerate(texts))), 2)
        assert sorted(r["doc_id"] for r in kept.collect()) == want


def nodes_of(spark, texts):
    """The distinct sets of texts, as near-copy removal takes them."""
    own = docs(spark, list(enumerate(texts)))
    return own, resemblance.printed(own).dropDuplicates(["node"])


def test_fingerprints_of_whole_sets(spark):
    """Each row's simhash is by its 5-word shingles, every one once."""
    texts = ["", "one two", "a b c d e a b c d e a b c d e f", " ".join(f"w{i}" for i in range(300))]
    want = []
    for text in texts:
        hashes = [xxhash.xxh64_intdigest(" ".join(run).encode(), 42) for run in runs_of_five(text) if run]
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    got = resemblance.printed(docs(spark, list(enumerate(texts)))).select("doc_id", "fp").collect()
    assert [r["fp"] & (1 << 64) - 1 for r in sorted(got)] == want


@pytest.mark.parametrize("most", [2, 64])
def test_fingerprints_find_near_copies_without_bands(spark, most):
    """Of near copies those within 2 bits are found by pigeonring chains alone, and decided by their sets."""
    rng, texts = random.Random(6), []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(600)]
        texts += [" ".join(words), " ".join([*words[:-1], f"new{rng.random()}"]), " ".join([*words, "more"])]
    own, uniq = nodes_of(spark, texts)
    prints = {r["node"]: r["fp"] & (1 << 64) - 1 for r in uniq.collect()}
    groups, want = brute_groups(set(prints.values())), {}
    for node, fp in prints.items():
        want.setdefault(groups[fp], set()).add(node)
    bare = uniq.withColumn("bands", F.array().cast("array<long>"))
    got = {}
    for r in components(resemblance.links(bare, own, most, simhash.close(uniq.select("node", "fp"), most))).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert len(got) > 20


def test_a_family_is_compared_in_proportion_to_its_size(spark, monkeypatch):
    """Near copies of one text, few of them near each other: it leads all groups, so each is compared about once."""
    rng, base, counts = random.Random(12), [f"w{i}" for i in range(150)], []
    sketched = resemblance._sketched

    def counting(pairs, uniq):
        out = sketched(pairs, uniq)
        counts.append(out.count())
        return out

    monkeypatch.setattr(resemblance, "_sketched", counting)
    texts = [" ".join(base)]
    for k in range(199):
        words = list(base)
        for at in rng.sample(range(150), 2):
            words[at] = f"new{k}"
        texts.append(" ".join(words))
    assert set(jaccard_groups(texts)) == {0}
    own, uniq = nodes_of(spark, texts)
    got = components(resemblance.links(uniq, own, 2)).collect()
    assert len(got) == len(texts) and len({r["root"] for r in got}) == 1
    assert sum(counts) < 5 * len(texts)


def test_star_of_near_copies(spark):
    """Copies of one text that are near it but not each other, more of them than are compared by pairs."""
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(200)], []
    for k in range(100):
        words = list(base)
        for at in rng.sample(range(0, 200, 10), 4):
            words[at] = f"new{k}"
        texts.append(" ".join(words))
    texts = [*texts[:50], " ".join(base), *texts[50:]]
    for most in (8, 64):
        kept = simhash.deduplicated(docs(spark, list(enumerate(texts))), most)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(jaccard_groups(texts))) == [0]


def test_shared_doc_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(50))
    rows = [(1, text("a")), (1, text("b")), (2, text("c")), (3, text("c")), (3, text("d")), (4, text("e")), (4, text("e"))]
    kept = simhash.deduplicated(wide(spark, rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [rows[0], rows[1], rows[2], rows[4], rows[5]]


def plain_tiling(doc, item, least):
    in_doc, in_item, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best, at = 0, []
        for p in range(len(doc)):
            for q in range(len(item)):
                k = 0
                while p + k < len(doc) and q + k < len(item) and doc[p + k] == item[q + k] and not in_doc[p + k] and not in_item[q + k]:
                    k += 1
                if k > best:
                    best, at = k, []
                if k == best:
                    at.append((p, q))
        if best < least:
            return total
        for p, q in at:
            if not any(in_doc[p : p + best]) and not any(in_item[q : q + best]):
                in_doc[p : p + best] = in_item[q : q + best] = [True] * best
                total += best


def test_tiles_are_greedy():
    rng = random.Random(0)
    for _ in range(200):
        doc, item = ([rng.randrange(4) for _ in range(rng.randrange(n))] for n in (60, 30))
        got = decontaminate.tiles(np.array(doc, dtype=np.int64), np.array(item, dtype=np.int64), 3)
        assert sum(n for _, _, n in got) == plain_tiling(doc, item, 3)
        assert all(doc[p : p + n] == item[q : q + n] for p, q, n in got)


def test_tiles_of_long_repetitive_texts():
    doc, item = np.zeros(100_000, dtype=np.int64), np.zeros(200, dtype=np.int64)
    began = time.time()
    assert decontaminate.tiles(doc, item) == [(0, 0, 200)]
    assert sum(n for _, _, n in decontaminate.tiles(doc, np.zeros(99_000, dtype=np.int64))) == 99_000
    rng = np.random.default_rng(2)
    words = rng.integers(0, 50, 100_000)
    assert sum(n for _, _, n in decontaminate.tiles(np.concatenate([words[50_000:], words[:50_000]]), words)) == 100_000
    assert time.time() - began < 20


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    turned = "zz Eta, theta; iota kappa lambda MU? yy alpha beta gamma delta epsilon zeta!"
    rows = [(1, f"before {item} after"), (2, turned), (3, "alpha beta gamma delta"), (4, None), (5, ""), (None, item), (1, f"before {item} after"), (6, "nothing to see " * 3000)]
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (None, "one two three four five six"), (10, item)], "item_id long, text string")
    got = decontaminate.annotated(wide(spark, rows), bench)
    assert got.columns == [*[c for c in wide(spark, rows).columns if c != "leaks"], "leaks"]
    found = sorted(((r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in got.collect() if r["leaks"]), key=str)
    assert found == sorted([(1, [10, 10]), (2, [10, 10]), (None, [10, 10]), (1, [10, 10])], key=str)
    assert sorted(r["doc_id"] for r in decontaminate.cleaned(docs(spark, rows), bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.cleaned(docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.cleaned(docs(spark, []), bench).count() == 0
    named = docs(spark, [(*r, "x", 1) for r in rows], "doc_id long, text string, key string, _more int")
    assert decontaminate.cleaned(named, bench).columns == named.columns and decontaminate.annotated(named, bench).columns == [*named.columns, "leaks"]
    told = decontaminate.annotated(docs(spark, rows), spark.createDataFrame([("ten", item), (None, item)], "item_id string, text string"))
    assert {tuple(x["item_id"] for x in r["leaks"]) for r in told.collect()} == {(), (None, "ten")}


def test_decontamination_against_brute_force(spark):
    """Few words, so that runs repeat within texts and are shared by many of them."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows, items = [(i, text(rng.randrange(80))) for i in range(60)], [(i, text(rng.randrange(30))) for i in range(25)]
    want = set()
    for (i, t), (j, x) in itertools.product(rows, items):
        n = plain_tiling(t.split(), x.split(), 5)
        if len(x.split()) >= 5 and n >= 0.5 * len(x.split()):
            want.add((i, j, n))
    got = decontaminate.annotated(docs(spark, rows), docs(spark, items, "item_id long, text string"))
    assert {(r["doc_id"], x["item_id"], x["covered"]) for r in got.collect() for x in r["leaks"]} == want != set()


def test_a_phrase_of_all_items_joins_nothing(spark):
    """Items that share a run of five words meet only the texts that hold more of them."""
    rng = random.Random(4)
    phrase = "which of the following is"
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    items = [(k, f"{phrase} {words(k, 20)}") for k in range(60)]
    rows = [(i, f"{words(1000 + i, 30)} {phrase} {words(2000 + i, 9)}") for i in range(40)] + [(100 + k, f"so {phrase} {words(k, 20)} then") for k in rng.sample(range(60), 10)]
    benchmark, own = spark.createDataFrame(items, "item_id long, text string"), docs(spark, rows)
    _, seeds = decontaminate._seeds_of_items(benchmark, 5, 0.5)
    met = decontaminate.candidates(decontaminate._candidates(own, seeds, 5), seeds)
    assert met.count() == 10
    assert sorted(r["doc_id"] for r in decontaminate.cleaned(own, benchmark).collect()) == list(range(40))
