"""Centroid clustering and the audit of sources, against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import centroids, divergence

VECTORS = "vec_id long, embedding array<double>, label int, v string, cluster int, distance long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECTORS)


def brute_lloyd(rows, k, dims, rounds, scale, seed):
    kept = [(i, [max(-centroids.MOST, min(centroids.MOST, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else str(i)
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{name(r[0])}".encode()).hexdigest(), np.array(r[1], dtype="<i4").tobytes()))[:k]
    centers = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=repr), centers


ODD = [
    *[(i, [((i * 7 + j * 3) % 11 - 5) / 3, (i % 5) - 2.5, float(j), -0.1 * i]) for i in range(40) for j in (0, 1)],
    (100, [1e300, -1e300, 0.0, 1.0]),
    (101, [float("nan"), 0.0, 0.0, 0.0]),
    (102, [float("inf"), 0.0, 0.0, 0.0]),
    (103, [None, 0.0, 0.0, 0.0]),
    (104, [1.0, 2.0, 3.0]),
    (105, []),
    (106, None),
    (None, [0.5, 0.5, 0.5, 0.5]),
    (None, [0.25, 0.5, 0.5, 0.5]),
]


@pytest.mark.parametrize(("k", "rounds"), [(1, 1), (5, 3), (16, 2), (500, 1)])
def test_lloyd(spark, k, rounds):
    made = centroids.lloyd(vectors(spark, ODD).repartition(3), k, 4, rounds, 64, 1)
    want, centers = brute_lloyd(ODD, k, 4, rounds, 64, 1)
    rows = sorted(map(tuple, made.rows.collect()), key=repr)
    assert rows == want and made.centroids.tolist() == centers
    sums = Counter()
    for _, c, d in rows:
        sums[c] += d
    assert made.inertia == [sums[c] for c in range(len(centers))]


def test_no_vectors(spark):
    assert centroids.lloyd(vectors(spark, []), 3, 4) is None
    assert centroids.lloyd(vectors(spark, ODD[-6:-4]), 3, 4) is None


TEXTS = "doc_id long, text string, lang string, source string, n long, term string, block int, place int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 2, 3) for i, (t, lang, s) in enumerate(rows)], TEXTS)


def brute_audit(rows, least, top):
    rows = [((t or ""), (lang or ""), (s or "")) for t, lang, s in rows]
    lower = {c: c + 32 for c in range(65, 91)}
    docs, own, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for t, lang, s in rows:
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)))
        docs[lang].update(set(found))
        own[lang, s].update(found)
        whole[lang].update(found)
    out = []
    for lang, s in own:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (counts[t] + 2) // total for t in kept]

        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine = p(own[lang, s])
        pairs = [(other, sum(map(f, mine, p(own[lang, other])))) for of, other in own if of == lang and other != s]
        more = [(t, f(a, b)) for t, a, b in zip(kept, mine, p(whole[lang]), strict=True) if own[lang, s][t] and a > b]
        order = lambda x: (-x[1], x[0].encode())
        out += [(lang, s, "pair", i, v, r) for r, (i, v) in enumerate(sorted(pairs, key=order), 1)]
        out += [(lang, s, "term", i, v, r) for r, (i, v) in enumerate(sorted(more, key=order)[:top], 1)]
    return sorted(out)


WORDS = ["Alpha", "beta", "ΓΆΜΜΑ", "delta1delta", "é", "é", "\U0001f600", "zz", "A_b", "ÄB", "Z"]


def sample(n, langs, sources, seed):
    rng = np.random.default_rng(seed)
    return [(" ".join(rng.choice(WORDS, rng.integers(0, 9))), langs[rng.integers(len(langs))], f"s{rng.integers(sources)}") for _ in range(n)]


@pytest.mark.parametrize(("block", "at_once"), [(1 << 16, 16), (2, 3)])
def test_audit(spark, block, at_once):
    rows = sample(300, ["en", "de"], 5, 1) + sample(90, ["fr"], 4, 2) + [(None, None, None), ("rare words", "xx", "a"), ("", "xx", "b"), ("Alpha " * 30, "one", "only")] + [("Alpha beta", "one", "only")] * 12
    rows += [("", "en", "silent"), (None, "en", None), ("no kept term", "yy", "a"), ("none here", "yy", "b"), ("", "yy", "c")]
    got = sorted(map(tuple, divergence.audited(texts(spark, rows).repartition(3), block=block, at_once=at_once).collect()))
    assert got == brute_audit(rows, 10, 10)


def test_audit_of_nothing(spark):
    assert divergence.audited(texts(spark, [])).collect() == []


def test_hot_source_and_long_text(spark):
    rows = sample(600, ["en"], 1, 3) + sample(60, ["en"], 6, 4) + [("Beta alpha " * 150_000, "en", "s3")]
    got = sorted(map(tuple, divergence.audited(texts(spark, rows), least_docs=2, top=3, block=4).collect()))
    assert got == brute_audit(rows, 2, 3)


@given(st.lists(st.integers(0, 9 * 10**15), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_weights_are_exact(counts):
    total = sum(counts) + 2 * len(counts)
    if total <= 9 * 10**15:
        assert divergence.weights(np.array(counts), total).tolist() == [1 + 10**9 * (n + 2) // total for n in counts]


def test_every_pair_meets_once():
    for players in range(2, 12):
        even = players + players % 2
        met = Counter()
        for r in range(even - 1):
            for i in range(players):
                host = r if i == even - 1 else (2 * r - i) % (even - 1)
                if host < i:
                    met[host, i] += 1
        assert met == Counter((a, b) for b in range(players) for a in range(b))
