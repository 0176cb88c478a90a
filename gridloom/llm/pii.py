"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors, in any case: at-signs, plus signs, digits, schemes and words that announce an
account or a secret. At each anchor a small parser expands to the borders of an address, number or value and validates it:

* email, ip, card, phone: the base kinds. An address around an at-sign; four dotted numbers of at most 255;
  16 to 19 digits, singly spaced or hyphenated, that pass Luhn; a plus sign with 8 to 15 digits.
* account: after a word such as IBAN or account, an IBAN of its country's length that passes mod 97, or 8 to 17 digits.
* login: a URL that carries a user name and password before its host.
* secret: after a word such as token, secret or password and an equals sign or colon (or after Bearer), 16 characters or more of letters and digits that vary as
  random ones do; after a password's word 8 are enough, if they hold a letter and a digit.

Time is in proportion to a text's length, whatever cues it repeats. Spans are in code points, end exclusive; those of one kind don't overlap, those of two kinds may. Whole texts are scanned. Null and
empty texts have no spans, and a null stays null when texts are redacted. Repeated rows, null doc_ids and other columns stay; columns named
`spans` and `text` are replaced where the result has them. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import documents, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login", "secret")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)").match
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_digits = re.compile(r"[0-9]+").match
_gap = re.compile(r"[\s:#.-]{0,8}").match
_iban = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){10,30}").match
_account = re.compile(r"(?i:\s*(?:no\.?|number|nr\.?|num\.?))?[\s:#.-]{0,8}([0-9](?:[ -]?[0-9]){7,16})(?![0-9])").match
_login = re.compile(r"[^\s:/@]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?").match
# what stands before a value; that it is long enough is seen from its first characters, where it ends only once for a run
_secret = re.compile(r"[\w-]{0,20}[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?(?=[A-Za-z0-9+/_.~=-]{16})").match
_bearer = re.compile(r"\s{1,3}(?=[A-Za-z0-9+/_.~=-]{16})").match
_password = re.compile(r"[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?(?=[^\s\"'<>]{8})").match
_key_run = re.compile(r"[A-Za-z0-9+/_.~=-]*").match
_word_run = re.compile(r"[^\s\"'<>]*").match

#: Words that announce an account or a secret, and how secrets after them are read.
ACCOUNT_WORDS = ("iban", "account", "acct")
SECRET_WORDS = {"token": _secret, "secret": _secret, "api_key": _secret, "api-key": _secret, "apikey": _secret, "access_key": _secret, "private_key": _secret, "bearer": _bearer, "password": _password, "passwd": _password, "pwd": _password}
#: Bits that a character of a secret carries at least, by the counts of its characters.
LEAST_BITS = 3.0
#: Characters of an IBAN by country (fixed values of ISO 13616).
IBAN_LENGTHS = {
    **{"AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29},
    **{"ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20},
    **{"LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25},
    **{"QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20},
}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word in ("@", "+", *"0123456789"):
        out.add_word(word, ("@" if word == "@" else "+" if word == "+" else "0", 1))
    for word in ("http://", "https://", "ftp://", "ssh://"):
        out.add_word(word, ("://", len(word)))
    for word in ACCOUNT_WORDS:
        out.add_word(word, ("account", len(word)))
    for word in SECRET_WORDS:
        out.add_word(word, (word, len(word)))
    out.make_automaton()
    return out


_ANCHORS = _automaton()
_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """The text in lower case, each character in its place."""
    out = text.lower()
    return out if len(out) == len(text) else text.translate(_LOWER)  # a character never becomes fewer


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int:
    """Where the IBAN that begins at a place ends; -1 if there is none: as many letters and digits as its country has, singly spaced, that pass mod 97."""
    m = _iban(text, at)
    left = IBAN_LENGTHS.get(m.group()[:2].upper(), 0) if m else 0
    end = at
    while left and end < len(text):
        left -= text[end] != " "
        end += 1
    if not m or left or end == at or end > m.end() or (end < len(text) and text[end].isascii() and text[end].isalnum()):
        return -1
    return end if mod97(text[at:end].replace(" ", "")) else -1


def random_like(counts: Counter[str]) -> bool:
    """Characters that vary as those of keys and hashes do, with letters and digits among them."""
    if not (any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)):
        return False
    size = counts.total()
    return sum(n * math.log2(size / n) for n in counts.values()) / size >= LEAST_BITS


class _Values:
    """Values that begin at one place after another of a text and end where a run of characters does.

    A cue in a value that was none begins another, which ends at the same place: its end and its characters come from those of the one before, so a run is read twice however many cues it has.
    """

    def __init__(self, text: str, run: Callable, stripped: str) -> None:
        self.text, self.run, self.stripped = text, run, stripped
        self.start = self.end = 0
        self.seen = 0
        self.counts: Counter[str] = Counter()

    def at(self, start: int) -> tuple[int, Counter[str]]:
        """Where the value ends, without stops, and how often it has each character."""
        if not self.start <= start < self.end:
            value = self.run(self.text, start).group()
            self.start = self.seen = start
            self.end = start + len(value)
            self.close = start + len(value.rstrip(self.stripped))
            self.counts = Counter(self.text[start : self.close])
        elif start < self.seen:  # a cue before the last one's place
            self.counts.update(self.text[start : min(self.seen, self.close)])
        else:
            self.counts.subtract(self.text[self.seen : min(start, self.close)])
            self.counts = +self.counts
        self.seen = start
        return max(start, self.close), self.counts


def spans(text: str) -> list[Span]:
    """All spans of a text, by kind as KINDS lists them, then by place."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended
    keys, words = _Values(text, _key_run, "."), _Values(text, _word_run, ".,;:)")

    def take(kind: str, start: int, end: int, valid: bool) -> None:
        past[kind] = end
        if valid:
            found[kind].append((kind, start, end))

    for end, (anchor, size) in _ANCHORS.iter(lowered(text)):
        at = end + 1 - size
        if anchor == "0":
            if at >= past["ip"]:
                if m := _ip(text, at):
                    take("ip", at, m.end(), all(int(x) <= 255 if len(x) < 9 else not x.strip("0") or int(x.lstrip("0")[:9]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split(".")))
                else:
                    past["ip"] = _digits(text, at).end()
            if at >= past["card"]:
                if m := _card(text, at):
                    digits = m.group().replace(" ", "").replace("-", "")
                    take("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
                else:
                    past["card"] = at + 1
        elif anchor == "@":
            start = at
            while start > past["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _domain(text, at + 1)):
                take("email", start, m.end(), True)
        elif anchor == "+":
            if at >= past["phone"] and (m := _phone(text, at)):
                take("phone", at, m.end(), 8 <= sum(c in "0123456789" for c in m.group()) <= 15)
        elif anchor == "://":
            if at >= past["login"] and (m := _login(text, end + 1)):
                take("login", at, m.end(), True)
        elif anchor == "account":
            if at >= past["account"]:
                first = _gap(text, end + 1).end()
                if (stop := iban_end(text, first)) > 0:
                    take("account", first, stop, True)
                elif m := _account(text, end + 1):
                    take("account", m.start(1), m.end(1), True)
        elif at >= past["secret"] and (m := SECRET_WORDS[anchor](text, end + 1)):
            start = m.end()
            if SECRET_WORDS[anchor] is _password:
                stop, counts = words.at(start)
                valid = stop - start >= 8 and any(map(str.isdigit, counts)) and any(map(str.isalpha, counts))
            else:
                stop, counts = keys.at(start)
                valid = stop - start >= 16 and random_like(counts)
            if valid:
                take("secret", start, stop, True)
    return [s for k in KINDS for s in found[k]]


def redacted(text: str, of: list[Span]) -> str:
    """The text with each span, or group of overlapping spans, as its (first) kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(of, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def located(docs: DataFrame) -> DataFrame:
    """docs with a column `spans`."""
    docs = docs.drop("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _SPANS)], [*part.schema.names, "spans"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", spans {SPANS}")


def masked(docs: DataFrame) -> DataFrame:
    """docs with the personal data in `text` replaced, and `n_chars`, if there is such a column, counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                names = part.schema.names
                nulls = part.column(names.index("text")).is_null().to_pylist()
                clean = [None if null else redacted(t, spans(t)) for t, null in zip(texts, nulls, strict=True)]
                new = {"text": pa.array(clean, pa.string())}
                if "n_chars" in names:
                    old = part.column(names.index("n_chars"))
                    new["n_chars"] = pa.array([was if c is None or c == t else len(c) for c, t, was in zip(clean, texts, old.to_pylist(), strict=True)], old.type)
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(names)], names)

    return docs.mapInArrow(run, docs.schema)


def op9_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans for every document, from the operator's spans."""
    out = located(documents(spark, sf_dir, "doc_id", "text")).drop("text")
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(told(of(*BASE)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
