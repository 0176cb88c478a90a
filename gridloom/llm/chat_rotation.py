"""Multi-party perspective rotation of conversations, with native expressions alone.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and
all others as named users, and the mask has the spans of the assistant's words, which are what a model is to learn.
Turns of a role named `system` belong to every rendering and are nobody's perspective.

A turn reads <|im_start|>assistant, <|im_start|>user name=NAME or <|im_start|>system, a line end, its text, <|im_end|> and a line end. Where a text or
name holds one of these two marks itself, a space is put after its first character, and line ends in names become spaces, so nothing said can begin or end a turn. A
rendering comes in segments of SEGMENT turns by their places in the conversation; a row for each, which together give the whole dialogue:
`text` of the segment, `start` (characters of the segments before it), and `mask`, spans (start, end) within the dialogue of each text with its <|im_end|>. So a
conversation of any length is never gathered in one row or task; usual ones have a single segment. `whole` joins the segments for those whose conversations fit in a row.

Null texts are empty, a null role is the participant `unknown`, a null turn comes first. Turns with the same number stand in the order of role and
text; repeated rows are said again. A row with a null conv_id belongs to nothing and is a conversation by itself. A conversation of system turns alone has no perspective
and no row, nor has an empty table. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._shared import staged, table

#: Turns in a segment, and segments in a block, whose lengths are summed in one place.
SEGMENT, BLOCK = 64, 1024
_END = "<|im_end|>"


def rotated(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, perspective, segment, n_turns, start, text, mask from turns (conv_id, turn, role, text).

    Texts are shuffled once, to their segments; places come from a table of lengths, which is joined to them there.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = said.filter("conv_id IS NULL AND role <> 'system'").select("conv_id", F.lit(0).cast("long").alias("segment"), F.array(F.struct("turn", "role", "text")).alias("turns"), F.col("role").alias("perspective"), F.lit(0).cast("long").alias("before"))
    talk = ["conv_id"]
    said = _placed(said.filter("conv_id IS NOT NULL"), talk, segment)
    # `segment` turns at most
    parts = said.groupBy(*talk, "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    seen = parts.join(_views(said, talk), [*talk, "segment"]).unionByName(alone)
    pieces = F.transform("turns", lambda t: F.struct(_head(t["role"], F.col("perspective")).alias("head"), F.concat(_plain(t["text"]), F.lit(_END)).alias("body"), (t["role"] == F.col("perspective")).alias("own")))
    seen = seen.withColumn("pieces", pieces)
    # each body's place: a running length over the pieces
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).alias("at"),
        F.when(p["own"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    first = F.struct(F.col("before").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return seen.select(
        "conv_id",
        "perspective",
        "segment",
        F.size("turns").cast("long").alias("n_turns"),
        F.col("before").alias("start"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("pieces", first, step, lambda a: a["spans"]).alias("mask"),
    )


def whole(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, text, mask: what `rotated` gives, a row for each dialogue. A dialogue has to fit in a row."""
    one = segments.filter("conv_id IS NOT NULL").groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("segment", "n_turns", "text", "mask"))).alias("parts"))
    joined = one.select("conv_id", "perspective", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n_turns"]).alias("n_turns"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.flatten(F.transform("parts", lambda p: p["mask"])).alias("mask"))
    return joined.unionByName(segments.filter("conv_id IS NULL").select(*joined.columns))


def _placed(said: DataFrame, talk: list[str], segment: int) -> DataFrame:
    """said with `segment`, by dense places in each conversation. No conversation meets in one task: rows are sorted over all partitions, and counts by partition tell where each conversation begins."""
    keys = [*talk, "turn", "role", "text"]
    spread = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = said.repartitionByRange(spread, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed, _ = staged(placed.withColumn("_part", F.shiftright("_at", 33)), "placed")
    parts = placed.groupBy(*talk, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(*talk).orderBy("_part")) - F.col("_n")  # a row for each partition
    bases = parts.select(*talk, "_part", (before - F.col("_first")).alias("_base"))
    return placed.join(bases, [*talk, "_part"]).withColumn("segment", F.floor((F.col("_at") + F.col("_base")) / segment).cast("long")).select(*said.columns, "segment")


def _plain(text: Column) -> Column:
    """A text without marks of its own."""
    return F.replace(F.replace(text, F.lit("<|im_start|>"), F.lit("< |im_start|>")), F.lit(_END), F.lit("< |im_end|>"))


def _head(role: Column, perspective: Column) -> Column:
    as_user = F.concat(F.lit("<|im_start|>user name="), F.translate(_plain(role), "\r\n", "  "))
    return F.concat(F.when(role == perspective, F.lit("<|im_start|>assistant")).when(role == "system", F.lit("<|im_start|>system")).otherwise(as_user), F.lit("\n"))


def _views(said: DataFrame, talk: list[str]) -> DataFrame:
    """For each segment its perspectives, with the characters of the segments before it in each. Counts and lengths alone meet here."""
    role, nobody = F.col("role"), F.lit(None).cast("string")
    as_user = F.length(_head(role, nobody)) + F.length(_plain(F.col("text"))) + len(_END) + 1
    per = said.groupBy(*talk, "segment", "role").agg(F.count("*").alias("own"), F.sum(as_user).alias("size"))
    per = per.withColumn("block", F.floor(F.col("segment") / BLOCK))
    speakers = per.filter("role <> 'system'").select(*talk, role.alias("perspective")).distinct()
    sizes = per.groupBy(*talk, "block", "segment").agg(F.sum("size").alias("size"))
    own = per.select(*talk, "segment", role.alias("perspective"), "own")
    # speakers meet a conversation's blocks first, so its segments are dealt by block
    blocks = sizes.select(*talk, "block").distinct().join(speakers, talk)
    grid = sizes.join(blocks, [*talk, "block"]).join(own, [*talk, "segment", "perspective"], "left")
    # as the assistant, a speaker's turns have another head
    less = F.length(_head(F.col("perspective"), nobody)) - F.length(_head(F.col("perspective"), F.col("perspective")))
    grid = grid.withColumn("size", F.col("size") - F.coalesce("own", F.lit(0)) * less)
    # sums within blocks, and sums of the blocks before
    view = [*talk, "perspective"]
    within = W.partitionBy(*view, "block").orderBy("segment")
    totals = grid.groupBy(*view, "block").agg(F.sum("size").alias("_block"))
    earlier = F.sum("_block").over(W.partitionBy(*view).orderBy("block")) - F.col("_block")
    grid = grid.withColumn("_within", F.sum("size").over(within) - F.col("size")).join(totals.select(*view, "block", earlier.alias("_earlier")), [*view, "block"])
    return grid.select(*talk, "segment", "perspective", (F.col("_within") + F.col("_earlier")).cast("long").alias("before"))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotated(table(spark, sf_dir, "conversations"))
    told = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "segment", "n_turns", "start", "text", told.alias("mask"))


ORACLE_SQL = rf"""
WITH said AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN 0 ELSE (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // {SEGMENT} END AS segment FROM conversations),
speakers AS (SELECT DISTINCT conv_id, alone, role AS perspective FROM said WHERE role <> 'system'),
shown AS (
  SELECT s.conv_id, s.alone, p.perspective, s.segment, s.turn, s.role, s.text, s.role = p.perspective AS own,
    CASE WHEN s.role = p.perspective THEN '<|im_start|>assistant' WHEN s.role = 'system' THEN '<|im_start|>system' ELSE '<|im_start|>user name=' || translate(replace(replace(s.role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), chr(13) || chr(10), '  ') END || chr(10) AS head,
    replace(replace(s.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '{_END}' AS body
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.alone IS NOT DISTINCT FROM p.alone),
placed AS (SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS body_at,
  sum(length(head) + length(body) + 1) OVER w - length(head) - length(body) - 1 AS head_at
  FROM shown WINDOW w AS (PARTITION BY conv_id, alone, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, segment, count(*) AS n_turns, CAST(min(head_at) AS BIGINT) AS start,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg(CAST(CAST(body_at AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(body_at + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY body_at) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, alone, perspective, segment"""
