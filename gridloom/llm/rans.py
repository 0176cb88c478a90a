"""Static range asymmetric numeral system (rANS) over token ids, in numpy.

A block of n ids is laid out as steps of LANES ids: lane j codes ids j, j + LANES, ...
with a state of its own, and all lanes write 32-bit words to one stream. The encoder runs
backwards; in a step, a decoder's lanes take words in the order of the lanes. Every EVERY
steps the states and the place in the stream are kept (a checkpoint), so the segments of a
block can be decoded at the same time, here as more rows of the same numpy arrays.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np

BITS = 20
LANES = 256
EVERY = 256
LOW = np.uint64(1 << 31)
_B, _W, _LIMIT = np.uint64(BITS), np.uint64(32), np.uint64(63 - BITS)
_MASK = np.uint64((1 << BITS) - 1)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies that sum to 2**BITS; an id that occurs keeps at least 1."""
    counts = np.asarray(counts, dtype=np.int64)
    whole, kinds = 1 << BITS, int((counts > 0).sum())
    if not kinds:
        return np.zeros(len(counts), dtype=np.int64)
    if kinds > whole:
        raise ValueError(f"{kinds} distinct ids don't fit in 2**{BITS}")
    share = counts / counts.sum() * (whole - kinds)
    out = np.floor(share).astype(np.int64)
    rest = whole - kinds - int(out.sum())
    order = np.argsort(-(share - out) + (counts == 0) * 2.0, kind="stable")
    out[order[:rest]] += 1
    return out + (counts > 0)


class Table:
    """Frequencies with what coding needs of them."""

    def __init__(self, freq: np.ndarray) -> None:
        freq = np.asarray(freq, dtype=np.int64)
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.filler = int(freq.argmax()) if len(freq) else 0
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


class Block(NamedTuple):
    n: int
    states: bytes  # of the lanes, at each checkpoint, the block's start first
    offsets: bytes  # where in the stream each checkpoint reads on
    words: bytes
    words_crc32: int
    ids_crc32: int


def encode(ids: np.ndarray, table: Table) -> Block:
    n = len(ids)
    steps = max(1, -(-n // LANES))
    grid = np.full(steps * LANES, table.filler, dtype=np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, LANES)
    f, c = table.freq[grid], table.cum[grid]
    if n and not f.all():
        raise ValueError("an id has no frequency in the table")
    top, gap = f << _LIMIT, np.uint64(1 << BITS) - f
    words, out = np.empty((steps, LANES), dtype=np.uint32), np.empty((steps, LANES), dtype=bool)
    x, kept = np.full(LANES, LOW, dtype=np.uint64), []
    for t in range(steps - 1, -1, -1) if n else ():
        m = np.greater_equal(x, top[t], out=out[t])
        words[t] = x  # the low half
        x = np.where(m, x >> _W, x)
        x += x // f[t] * gap[t]  # the quotient times 2**BITS, and the remainder
        x += c[t]
        if t % EVERY == 0:
            kept.append((t, x))
    kept = kept[::-1] or [(0, x)]
    before = np.concatenate([[0], np.cumsum(out.sum(axis=1))]) if n else np.zeros(1, dtype=np.int64)
    stream = (words[out] if n else words[:0].ravel()).astype("<u4").tobytes()
    return Block(n, np.stack([x for _, x in kept]).astype("<u8").tobytes(), before[[t for t, _ in kept]].astype("<i8").tobytes(), stream, zlib.crc32(stream), zlib.crc32(np.asarray(ids).astype("<u4").tobytes()))


def decode(block: Block, table: Table) -> np.ndarray:
    """The ids of a block, all its segments at once. Raises ValueError when a checksum doesn't hold."""
    if zlib.crc32(block.words) != block.words_crc32:
        raise ValueError("the words of a block don't match their checksum")
    if not block.n:
        return np.zeros(0, dtype=np.uint32)
    steps = -(-block.n // LANES)
    x = np.frombuffer(block.states, dtype="<u8").reshape(-1, LANES).astype(np.uint64)
    at = np.frombuffer(block.offsets, dtype="<i8").astype(np.int64)
    words = np.append(np.frombuffer(block.words, dtype="<u4"), np.uint32(0)).astype(np.uint64)
    grid = np.empty((len(x) * EVERY, LANES), dtype=np.uint32)
    last = steps - (len(x) - 1) * EVERY
    for k in range(min(EVERY, steps)):
        if k == last:
            x, at = x[:-1], at[:-1]
        slot = x & _MASK
        s = table.symbol[slot]
        grid[k : (len(x) - 1) * EVERY + k + 1 : EVERY] = s
        x = table.freq[s] * (x >> _B) + slot - table.cum[s]
        need = x < LOW
        order = np.cumsum(need, axis=1)
        x = np.where(need, x << _W | words[np.minimum(at[:, None] + order - 1, len(words) - 1) * need], x)
        at = at + order[:, -1]
    ids = grid[:steps].ravel()[: block.n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != block.ids_crc32:
        raise ValueError("the ids of a block don't match their checksum")
    return ids
