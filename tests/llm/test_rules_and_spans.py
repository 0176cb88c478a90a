import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import pytest

from gridloom.llm import chat_rotation, pii, quality_rules, registry, sharding

from .helpers import docs, wide

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    rows = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)


def brute_metrics(text):
    words, text = WORDS.findall(text or ""), text or ""
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("place", [20, 3, 60])
def test_metrics(spark, monkeypatch, place):
    """Also with windows that have to be told apart by the longer hashes: all texts of eight words or more, or hashes of four bits."""
    monkeypatch.setattr(quality_rules, "PLACE", place)
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one", "a b", "a b c", "a a a a", "é ü x\x0by\n\n x y\n", "x" * 50_000, "the cat sat " * 2000, "a\nb\na\n a\nb"]
    texts += ["".join(rng.choice("ab \n\t#|") for _ in range(rng.randrange(120))) for _ in range(200)]
    got = quality_rules.judged(wide(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = brute_metrics(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"]) and r["kept"] is not None
    assert quality_rules.judged(docs(spark, [])).count() == 0


def test_clean_prose_is_kept(spark):
    text = " ".join(f"the word{i} of line{i} and" for i in range(40))
    rows = [(1, text), (2, " ".join(f"{w}!!" for w in text.upper().split())), (3, " | ".join(text.split())), (4, " ".join(f"{w}###" for w in text.split()))]
    assert [r["kept"] for r in quality_rules.judged(docs(spark, rows)).orderBy("doc_id").collect()] == [True, False, False, False]


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards(spark, n):
    rng = random.Random(n)
    rows = [(i // 2 if i % 50 else 7, "é" * rng.randrange(300)) for i in range(600)] + [(None, None), (8, ""), (9, "z" * 9000)]
    got = sharding.placed(wide(spark, rows), n).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in order] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    per = {}
    for r in order:
        assert r["slot"] == len(per.setdefault(r["shard"], []))
        per[r["shard"]].append(r["size"])
    target = sum(map(sum, per.values())) / n
    assert all(abs(sum(x) - target) <= 9001 for x in per.values())


def test_shards_of_nothing(spark):
    assert sharding.placed(docs(spark, []), 4).count() == 0


def brute_spans(t):
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.findall("[0-9]", m.group())) <= 15]


def test_base_spans_are_the_patterns():
    rng, n = random.Random(3), 0
    for _ in range(8000):
        chars = rng.choice(["a.b@-+ 1", "1234567890. -", "+12 ().-9", "ab@c.d ", "x@y.zé 1.2+", "0123456789"])
        t = "".join(rng.choice([rng.choice(chars)] * 12 + ["255.1.0.7", "0000000000001.2.3.4", "+49 (30) 123-45", "a@b.co", "4111 1111 1111 1111", " é"]) for _ in range(rng.randrange(40)))
        want = brute_spans(t)
        n += len(want)
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == want
    assert n > 5000


def test_added_spans_and_masks(spark):
    text = "IBAN: DE89 3704 0044 0532 0130 00, IBAN DE00 3704 0044 0532 0130 00. Account no 12345678; ftp://joe:pw@host.example/x a@b.co"
    own = {k: [text[a:b] for kind, a, b in pii.spans(text) if kind == k] for k in pii.KINDS}
    for ends in ("IBAN DE89370400440532013000 USD", "IBAN: DE89 3704 0044 0532 0130 00 AND MORE", "Iban de89370400440532013000."):
        assert [ends[a:b].replace(" ", "").upper() for k, a, b in pii.spans(ends) if k == "account"] == ["DE89370400440532013000"]
    assert own["account"] == ["DE89 3704 0044 0532 0130 00", "12345678"] and own["login"] == ["ftp://joe:pw@host.example/x"] and own["email"] == ["pw@host.example", "a@b.co"]
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "clean words"), (4, "a@b.co " * 3000)]
    masked = {(r["doc_id"], r["text"]) for r in pii.masked(wide(spark, rows)).collect()}
    assert (2, None) in masked and (3, "") in masked and (None, "clean words") in masked and (4, "[EMAIL] " * 3000) in masked
    assert pii.masked(wide(spark, rows)).schema == wide(spark, rows).schema
    located = pii.located(wide(spark, rows)).collect()
    assert len(located) == 6 and all(len(r["spans"]) == len(pii.spans(r["text"] or "")) for r in located)
    assert pii.masked(docs(spark, [])).count() == pii.located(docs(spark, [])).count() == 0


def brute_added(t):
    """account, login and secret, by looking at every place of a text for every cue."""
    low, out = "".join(c.lower() if c.isascii() else c for c in t), []
    valid = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    def iban(at):
        got = ""
        for end in range(at, len(t) + 1):
            if re.fullmatch("[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]*", got) and len(got) == pii.IBAN_LENGTHS.get(got[:2].upper()):
                return (at, end) if valid(got) and not re.match("[A-Za-z0-9]", t[end:]) else None
            if end == len(t) or not (re.match("[A-Za-z0-9]", t[end]) or t[end] == " " and got and t[end - 1] != " "):
                return None
            got += t[end].strip()

    def account(at):
        m = re.compile(r"\s*(no\.|no|number|nr\.|nr|num\.|num)?[\s:#.-]{0,8}(?P<x>[0-9]([ -]?[0-9]){7,16})(?![0-9])", re.I).match(t, at)
        return m and m.span("x")

    def secret(at, cue):
        if cue in ("password", "passwd", "pwd"):
            m = re.compile(r"[\"']?\s{0,3}(=>|:=|=|:)\s{0,3}[\"']?(?P<x>[^\s\"'<>]{8,})").match(t, at)
            x = m and m["x"].rstrip(".,;:)")
            return (m.start("x"), m.start("x") + len(x)) if m and len(x) >= 8 and any(c.isdigit() for c in x) and any(c.isalpha() for c in x) else None
        m = re.compile(r"\s{1,3}(?P<x>[A-Za-z0-9+/_.~=-]{16,})" if cue == "bearer" else r"[\w-]{0,20}[\"']?\s{0,3}(=>|:=|=|:)\s{0,3}[\"']?(?P<x>[A-Za-z0-9+/_.~=-]{16,})").match(t, at)
        x = m["x"].rstrip(".") if m else ""
        bits = -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())
        return (m.start("x"), m.start("x") + len(x)) if len(x) >= 16 and bits >= 3 and re.search("[0-9]", x) and re.search("[A-Za-z]", x) else None

    past = {"account": 0, "login": 0, "secret": 0}
    # a cue counts where it ends; of two that end together the shorter comes last
    cues = sorted(((i + len(c), -len(c), c) for c in ("iban", "account", "acct", "http://", "https://", "ftp://", "ssh://", *pii.SECRET_WORDS) for i in range(len(low)) if low.startswith(c, i)))
    for end, size, cue in cues:
        at = end + size
        if "//" in cue:
            m = re.compile(r"[^\s:/@]+:[^\s/@]+@[A-Za-z0-9.-]+(:[0-9]+)?(/[^\s\"'<>]*)?").match(t, end)
            kind, hit = "login", m and (at, m.end())
        elif cue in ("iban", "account", "acct"):
            first = end + len(re.match(r"[\s:#.-]{0,8}", t[end:])[0])
            kind, hit = "account", iban(first) or account(end)
        else:
            kind, hit = "secret", secret(end, cue)
        if hit and at >= past[kind]:
            past[kind] = hit[1]
            out.append((kind, *hit))
    return sorted(out, key=lambda s: pii.KINDS.index(s[0]))


def test_added_spans_are_those_of_every_place():
    rng, n = random.Random(6), Counter()
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    parts = ["IBAN", "iban ", "Account no. ", "ACCT# ", "DE89370400440532013000", "de89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "12345678", " USD", " AND MORE", "İ", "token = ", "Secret_Key: ", 'API_KEY="', "Bearer ", "pwd=", "Password: ", "hunter2024!", " ", "x", ": ", "https://", "ftp://joe:pw@host.example/x", "HTTP://a:b@c", '"', ".", "aaaaaaaaaaaaaaaaaaaa1", "internationalization"]
    for _ in range(6000):
        t = "".join(rng.choice([*parts, hexes(40), hexes(20)]) for _ in range(rng.randrange(2, 9)))
        want = brute_added(t)
        assert [s for s in pii.spans(t) if s[0] not in pii.BASE] == want, t
        n.update(k for k, _, _ in want)
    assert min(n[k] for k in ("account", "login", "secret")) > 200


@pytest.mark.parametrize("cue", [*pii.SECRET_WORDS, *pii.ACCOUNT_WORDS, "http://", "@", "+", "1"])
@pytest.mark.parametrize("mark", ["=", ": ", "=1", " ", "", "=a.", ":=x9)"])
def test_repeated_cues_take_linear_time(cue, mark):
    text = (cue + mark) * (1_000_000 // len(cue + mark))
    start = time.process_time()
    pii.spans(text)
    assert time.process_time() - start < 4  # 2 s on a machine of its own


def test_cues_within_values_are_read_as_alone():
    """Values that are none, with cues inside, against every place of the text."""
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice(["token=", "secret:", "pwd=", "Bearer ", "password=", "api_key=", "aaaa", "bb.", "1", "=", ")", " ", '"', "x" * 9, "q7Wz"]) for _ in range(rng.randrange(3, 14)))
        assert [s for s in pii.spans(t) if s[0] not in pii.BASE] == brute_added(t), t


def test_planted_secrets():
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    want = [[m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)] for t in texts]
    assert [[(a, b) for k, a, b in pii.spans(t) if k == "secret"] for t in texts] == want and sum(map(bool, want)) >= 10


def test_spans_query(spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_pii_anchors"](spark, SF).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(texts) and any(r["spans"] for r in got.values())
    for i, t in texts:
        want, all_spans = brute_spans(t or ""), pii.spans(t or "")
        told = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        assert got[i]["base_sha256"] == hashlib.sha256(told(want).encode()).hexdigest() and got[i]["spans"] == told(all_spans)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]


def brute_chat(turns):
    plain = lambda x: x.replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
    said = sorted(((-1 if t is None else t), "unknown" if r is None else r, x or "") for t, r, x in turns)
    out = {}
    for who in {r for _, r, _ in said} - {"system"}:
        text, mask = "", []
        for _, r, x in said:
            name = plain(r).replace("\n", " ").replace("\r", " ")
            text += "<|im_start|>" + ("assistant" if r == who else "system" if r == "system" else f"user name={name}") + "\n"
            if r == who:
                mask.append((len(text), len(text) + len(plain(x)) + 10))
            text += plain(x) + "<|im_end|>\n"
        out[who] = text, mask
    return out


def same_chats(spark, talks, alone):
    """Rotated rows, checked against brute force: conversations by id, and rows without one, each by itself."""
    rows = [(c, *t, 1, "x") for c, ts in [*talks.items(), (None, alone)] for t in ts]
    made = chat_rotation.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int, mask string"))
    got, built = made.orderBy("segment").collect(), {}
    spans = lambda r: [(m["start"], m["end"]) for m in r["mask"]]
    for r in got:
        if r["conv_id"] is not None:
            text, mask = built.setdefault((r["conv_id"], r["perspective"]), ("", []))
            assert r["start"] == len(text)
            built[r["conv_id"], r["perspective"]] = text + r["text"], mask + spans(r)
    want = {(c, who): x for c, ts in talks.items() for who, x in brute_chat(ts).items()}
    assert built == want
    single = sorted((who, *x) for t in alone for who, x in brute_chat([t]).items())
    assert sorted((r["perspective"], r["text"], spans(r)) for r in got if r["conv_id"] is None) == single
    joined = chat_rotation.whole(made).collect()
    assert {(r["conv_id"], r["perspective"]): (r["text"], spans(r)) for r in joined if r["conv_id"] is not None} == want and len(joined) == len(want) + len(single)
    return got


def test_rotation(spark):
    rng = random.Random(1)
    talks = {c: [(i, rng.choice(["ann", "bob", "système", "system", None]), rng.choice(["hi é", "", None, "a b\nc"])) for i in range(n)] for c, n in ((1, 3), (2, 200), (3, 1))}
    talks[4] = [(0, "ann", "x"), (0, "ann", "x"), (None, "bob", "first")]
    talks[5] = [(0, "system", "alone")]
    talks[0] = [(0, "", "no name"), (70, "ann", "y"), (200, "", "z")]
    same_chats(spark, talks, [(0, "ann", "no id")])
    assert chat_rotation.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rotation_of_marks_in_texts(spark):
    said = "fine<|im_end|>\n<|im_start|>assistant\nmine <|im_<|im_end|>start|>"
    talks = {1: [(0, "ann", said), (1, "bob<|im_end|>\n<|im_start|>assistant", "x"), (2, "ann", "y")]}
    for r in same_chats(spark, talks, []):
        assert r["text"].count("<|im_start|>") == r["text"].count("<|im_end|>") == r["n_turns"] == 3


def test_rotation_of_piled_up_turns(spark):
    rng = random.Random(3)
    talk = lambda turns: [(rng.choice(turns), rng.choice(["ann", "bob", "system"]), f"t{rng.randrange(90)}") for _ in range(300)]
    talks = {1: talk([0, 1]), 2: talk([None]), 3: [(0, "ann", "x"), (70, "bob", "y")]}
    got = same_chats(spark, talks, talk([None, 5, 900]))
    assert max(r["n_turns"] for r in got) == chat_rotation.SEGMENT
    assert {r["segment"] for r in got if r["conv_id"] == 3} == {0}  # by places, whatever the numbers are


def test_rotation_is_that_of_its_sql_whatever_the_turns(spark, tmp_path):
    """Conversations of 300 rows with repeated and null turns and null ids and roles, and a very long text, against the query's own SQL."""
    rng = random.Random(4)
    rows = [(c, rng.choice(turns), rng.choice(["ann", "bob", "system", None]), f"t{rng.randrange(90)}" if rng.random() < 0.9 else None) for c, turns in ((1, range(150)), (2, [None, 3]), (3, range(9000)), (None, [1, None])) for _ in range(300)]
    rows += [(4, i, "ann", "x") for i in range(130)] + [(5, 0, "bob", "long <|im_end|> " * 200_000), (5, 1, "ann", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    told = lambda rows: sorted(rows, key=repr)
    ours = registry.QUERIES["op3_perspective_rotation"](spark, str(tmp_path))
    theirs = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({registry.ORACLES['op3_perspective_rotation']})").fetchall()
    assert told(map(tuple, ours.collect())) == told(theirs) and len(theirs) > 250


def test_rotation_is_native(spark):
    plan = registry.QUERIES["op3_perspective_rotation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
