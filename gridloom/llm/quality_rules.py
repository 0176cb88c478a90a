"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Words are runs of characters other than space and U+0009 to U+000D. Every rule is a row of the table: a
metric's name and the least and largest value that pass. Null and empty texts have no words, so
they fail the base rules. Repeated rows, null doc_ids and other columns stay as they are unless
their names are those of the result, which then replaces them; an empty table gives no rows.

A text whose 3-word windows have as many hashes repeats none. In others, repeated ones are found by sorting a long for each: the first bits of its hash and its place. Where two windows of one text
agree in these bits but not in their words, or a text has a million of them, two hashes of 64 bits and the place are sorted instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import documents, unused

#: Frequent words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from he in is it not of on or that the this to was what with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "als auf aus das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "al como con de del el en es la las lo los no para por que se su un una y"
)


class Rule(NamedTuple):
    metric: str
    least: float | None
    most: float | None


RULES = (
    Rule("mean_word_chars", 2, 20),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("bar_word_ratio", None, 0.1),
    Rule("shout_word_ratio", None, 0.3),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.4),
)

_GAP = r"[\x20\x09-\x0D]+"


def _ratio(part: Column, whole: str) -> Column:
    return F.coalesce(part / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


#: Bits of a window's place beside the bits of its hash.
PLACE = 20


def _twins(windows: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Where in a sorted array of two or more an element equals the one before."""
    return F.filter(F.sequence(F.lit(1), F.size(windows) - 1), lambda i: same(F.get(windows, i - 1), F.get(windows, i)))


def _places(windows: Column, twins: Column, place: Callable[[Column], Column]) -> Column:
    """The places, in order, of the elements that have an equal beside them."""
    return F.sort_array(F.array_distinct(F.concat(F.transform(twins, lambda i: place(F.get(windows, i - 1))), F.transform(twins, lambda i: place(F.get(windows, i))))))


def metrics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios that rules name."""
    text = F.coalesce("text", F.lit(""))
    words, lines, hashes, short, near, wide, at, n_lines, stops, bars, shouts = inner = [unused(docs, x) for x in ("words", "lines", "hashes", "short", "near", "wide", "at", "n_lines", "stops", "bars", "shouts")]
    out = docs.withColumns({words: F.array_remove(F.split(text, _GAP, -1), ""), lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    word = lambda p, j: F.get(words, p + j)
    hashed = lambda p, *order: F.xxhash64(*[word(p, j) for j in order])
    out = out.withColumn(hashes, F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda p: hashed(p, 0, 1, 2))).otherwise(F.array().cast("array<bigint>")))
    low = F.lit((1 << PLACE) - 1).cast("long")
    place = lambda s: s.bitwiseAND(low).cast("int")
    # most texts repeat none
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    packed = F.sort_array(F.transform(hashes, lambda h, p: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(p.cast("long"))))
    out = out.withColumn(short, F.when(some & (F.size(words) < 1 << PLACE), packed))
    out = out.withColumn(near, F.when(F.col(short).isNotNull(), _twins(F.col(short), lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE) == 0)))
    differ = lambda p, q: ~reduce(and_, [word(p, j) == word(q, j) for j in range(3)])
    clash = F.exists(near, lambda i: differ(place(F.get(short, i - 1)), place(F.get(short, i))))
    long = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("a"), hashed(p, 2, 1, 0, 1).alias("b"), p.alias("p"))))
    out = out.withColumn(wide, F.when(some & (F.col(short).isNull() | clash), long))
    twice = _places(F.col(wide), _twins(F.col(wide), lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])), lambda s: s["p"])
    out = out.withColumn(at, F.when(F.col(wide).isNotNull(), twice).when(F.col(short).isNotNull(), _places(F.col(short), F.col(near), place)).otherwise(F.array().cast("array<int>")))
    # windows that start less than 3 words apart share words
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"])
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            n_lines: F.size(lines),
            stops: F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS.split())))),
            bars: F.size(words) - F.size(F.array_remove(words, "|")),
            shouts: F.size(F.filter(words, lambda w: w.endswith("!!"))),
        }
    )
    out = out.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), "n_words"),
            "symbols_per_word": _ratio(F.col("n_symbols"), "n_words"),
            "stop_word_ratio": _ratio(F.col(stops), "n_words"),
            "bar_word_ratio": _ratio(F.col(bars), "n_words"),
            "shout_word_ratio": _ratio(F.col(shouts), "n_words"),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), n_lines),
            "repeat_word_ratio": _ratio(F.col("n_repeat_words"), "n_words"),
        }
    )
    return out.drop(*inner)


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of thresholds as one condition."""
    out = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            out = out & (F.col(rule.metric) >= rule.least)
        if rule.most is not None:
            out = out & (F.col(rule.metric) <= rule.most)
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the metrics, base_failed and kept."""
    out = metrics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & passes(rules))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
_CLASS = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_CLASS}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS stops, len(list_filter(words, lambda x: x = '|')) AS bars, len(list_filter(words, lambda x: x LIKE '%!!')) AS shouts
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.02 AND bars / n_words <= 0.1
  AND shouts / n_words <= 0.3 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AND n_repeat_words / n_words <= 0.4 AS kept
FROM b"""
