"""Finding every window of W tokens that starts more than once, by content-defined anchors.

The k-gram of least hash inside a window is the window's anchor. Equal windows have the same anchor
at the same place, so whatever repeats is found among windows that share an anchor, and an anchor
that occurs once settles all its windows at once. Consecutive windows with the same anchor make one
row (a run): about one for every (W - k + 2) / 2 tokens.

Runs are equal if their anchor hash (64 bits) and the digest of all their tokens (another 128) are.
 - A run that occurs twice or more: all its windows repeat, at every occurrence.
 - An anchor under which different runs stand: their windows may still agree in part. One
   representative of each of those runs goes on to an exact comparison of single windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, spread

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_BITS = np.uint64(21)
#: Tokens that are hashed at once.
PIECE = 1 << 20
RUN_DDL = "h long, seg long, seg2 long, key binary, lo long, n int, off int"
#: What identifies a run.
RUN = ["h", "seg", "seg2"]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all `gram` consecutive tokens, a polynomial modulo 2^64 by prefix sums."""
    up, down = _power_tables(len(tokens))
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[: len(tokens)], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(tokens) - gram + 1])


def anchor_runs(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows in texts that lie one after another in `tokens` (fewer than 2^21):
    first window start, number of windows, place of the anchor, anchor hash."""
    counts = np.maximum(ends - starts - window + 1, 0)
    at = ranges(starts, counts)
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    g = gram_hashes(tokens, gram)
    span = window - gram + 1
    low = (np.uint64(1) << _BITS) - np.uint64(1)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    blocks = np.full((len(key) + span - 1) // span * span, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(after[at], before[at + span - 1]) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return at[first], np.diff(np.r_[first, len(at)]), place[first], g[place[first]]


def run_rows(texts: Iterator[tuple[bytes, np.ndarray, bytes, int]], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """texts: (key, tokens, the same tokens as bytes, bytes a token). Rows of RUN_DDL."""
    held: list[tuple[bytes, int, np.ndarray, bytes]] = []
    size = width = 0

    def flush():
        tokens = np.concatenate([x[2] for x in held])
        ends = np.cumsum([len(x[2]) for x in held])
        starts = ends - [len(x[2]) for x in held]
        lo, n, place, h = anchor_runs(tokens, starts, ends, window, gram)
        raw, digest = b"".join(x[3] for x in held), xxhash.xxh3_128_digest
        a, z, off = (lo * width).tolist(), ((lo + n + window - 1) * width).tolist(), place - lo
        seg = np.frombuffer(b"".join([digest(raw[i:j], o) for i, j, o in zip(a, z, off.tolist())]), np.int64).reshape(-1, 2)
        text = np.searchsorted(ends, lo, side="right")
        keys, base = pa.array([x[0] for x in held], pa.binary()), np.array([x[1] for x in held], np.int64)
        return pa.record_batch(
            [
                pa.array(h.view(np.int64)),
                pa.array(seg[:, 0]),
                pa.array(seg[:, 1]),
                keys.take(pa.array(text)),
                pa.array(lo - starts[text] + base[text] if len(lo) else lo),
                pa.array(n.astype(np.int32)),
                pa.array(off.astype(np.int32)),
            ],
            names=["h", "seg", "seg2", "key", "lo", "n", "off"],
        )

    for key, tokens, raw, width in texts:
        if len(tokens) < window:
            continue
        # a text longer than a piece goes in overlapping pieces, each with window starts of its own
        for a in range(0, len(tokens) - window + 1, PIECE):
            part = tokens[a : a + PIECE + window - 1]
            if held and size + len(part) > PIECE:
                yield flush()
                held, size = [], 0
            held.append((key, a, part, raw[a * width : (a + len(part)) * width]))
            size += len(part)
    if held:
        yield flush()


def runs_of(docs: DataFrame, tokens_of: Callable, window: int, gram: int) -> DataFrame:
    """docs: key, text. tokens_of(text) -> (tokens, bytes, width), None for a null text."""

    def run(batches):
        for b in batches:
            keys, column = b[0].to_pylist(), b[1]
            texts = ((k, *got) for k, t in zip(keys, column) if (got := tokens_of(t.as_py())) is not None)
            yield from run_rows(texts, window, gram)

    return spread(docs.select("key", "text")).mapInArrow(run, RUN_DDL)


def classes_of(runs: DataFrame) -> DataFrame:
    """One row for each distinct run: its occurrences `c` and a representative."""
    return runs.groupBy(*RUN).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "lo", "n", "off")).alias("rep"))


def repeated(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """key, lo, n: the occurrences of runs that occur twice or more."""
    return runs.join(classes.where("c > 1").select(*RUN), RUN).select("key", "lo", "n")


def in_question(classes: DataFrame) -> DataFrame:
    """h, c, k, key, lo, n, off: representatives of the k distinct runs under one anchor, k > 1."""
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return classes.join(several, "h").select("h", "c", "k", "rep.key", "rep.lo", "rep.n", "rep.off")


def by_text(runs: DataFrame, *columns: str) -> DataFrame:
    """Each key's distinct runs: rows that repeat whole share a key, and their runs are one another's."""
    return runs.groupBy("key").agg(F.collect_set(F.struct(*columns)).alias("runs"))
