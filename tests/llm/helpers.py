"""Small tables with the cases that every operator has to stand."""

from __future__ import annotations

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, leaks int, part int, ids string"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def wide(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 0.5, 1, 2, "y") for i, t in rows], DOCS)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
