"""Counts of character n-grams as sparse rows, for the classifiers of this subpackage.

A text's bytes, lower-cased where they are ASCII letters or kept as they are, are read two and three at a time; each n-gram
falls into one of a fixed number of bins by a multiplicative hash. The work is numpy over many texts at once.
"""

from __future__ import annotations

import numpy as np

from gridloom.llm._shared import starts_of

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER = _LOWER.copy()
_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def ngram_counts(texts: list[str], bins: int, n: int, lower: bool, letters: bool = False) -> np.ndarray:
    """A row of counts for each text: n-grams of its bytes with a space put before and after, digits taken as one.

    With `letters`, what is in ASCII but no letter counts as a space, and spaces in a row as one.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 2
    data = np.frombuffer(b"".join(x for r in raw for x in (b" ", r, b" ")), dtype=np.uint8)
    data = _LETTER[data] if letters else np.where(_DIGIT[data], np.uint8(48), _LOWER[data] if lower else data)
    if letters and len(data):
        kept = np.ones(len(data), dtype=bool)
        kept[1:] = (data[1:] != 32) | (data[:-1] != 32)
        kept[starts_of(lens)] = True
        data, lens = data[kept], np.add.reduceat(kept, starts_of(lens), dtype=np.int64)
    code = data[: len(data) - n + 1].astype(np.uint32) if len(data) >= n else np.zeros(0, dtype=np.uint32)
    for j in range(1, n):
        code = code << np.uint32(8) | data[j : len(data) - n + 1 + j]
    shift = np.uint64(64 - (bins - 1).bit_length())
    with np.errstate(over="ignore"):
        code = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
    out = np.empty((len(texts), bins), dtype=np.float32)
    for i, (a, k) in enumerate(zip(starts_of(lens).tolist(), lens.tolist(), strict=True)):
        out[i] = np.bincount(code[a : a + max(0, k - n + 1)], minlength=bins)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def snapped(rows: np.ndarray, bits: int) -> np.ndarray:
    """Values as multiples of 2**-bits, of at most 1: products of such rows are exact in doubles while 2 * bits and the row's length fit in 53 bits,
    so they don't depend on how rows are put together in blocks."""
    return np.rint(np.asarray(rows, dtype=np.float64) * (1 << bits)) / (1 << bits)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log counts times idf, of length 1."""
    return unit(np.log1p(counts) * idf)
