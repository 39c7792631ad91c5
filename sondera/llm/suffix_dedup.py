"""Exact substring removal: bytes covered by a 200-byte string that also starts anywhere else.

1. Anchors (repeats.py) split every text into runs of windows, without leaving a window out. A run
   that occurs twice is settled; an anchor that occurs once is settled too.
2. What is left is one representative of each distinct run that shares its anchor with another.
   Their bytes, sharded by anchor, are sorted by external induced sorting with common-prefix values
   (induced.py): neighbours that share 200 bytes or more are windows that repeat. Equal runs are one
   row of the shard: suffixes of equal bytes would only be sorted to find what the digests tell. What
   lies beside the anchor is marked at `MARKS` distances to either side; the farthest mark that a
   segment has in common with another of its anchor bounds how far its repeated windows reach, and
   bytes that no such window reaches are not sorted.
3. Each text is met by its intervals once, and what stays is digested.

Equal windows stand under equal anchors, so shards never miss a pair. An anchor with more than
`SLICE` distinct runs is cut into slices by the window's distance from the anchor, which equal
windows have in common, so that one frequent passage does not make one large shard.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc  # noqa: F401  binds pa.ipc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import covered, materialize, read, release, row_key
from .induced import Shard
from .repeats import by_text, classes_of, in_question, repeated, runs_of

WINDOW, GRAM, SLICE, SHARD, MARKS = 200, 48, 512, 1 << 24, 8
#: One number for each byte value, so that the anchor hash has no regard for the bytes' order.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_tokens(text: str | None):
    if not text:
        return None
    raw = text.encode("utf-8", "surrogatepass")
    return _BYTE[np.frombuffer(raw, np.uint8)], raw, 1


def _mark(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) >> 1 | 1


def _distances(window: int) -> list[int]:
    """Distances from the anchor, ascending, at which what lies beside it is marked."""
    beside = window - min(GRAM, window)
    return sorted({beside * i // MARKS for i in range(1, MARKS + 1)} - {0})


def _names(window: int) -> tuple[list[str], list[str]]:
    return tuple([f"{side}{i}" for i in range(len(_distances(window)))] for side in ("left", "right"))


def _segments(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """Shard columns, key, first window, c, bytes, the first window's distance from the anchor and the
    marks of every run in question."""
    span = window - GRAM + 1 if window > GRAM else 1
    # windows of a run lie at distances off, off - 1, ... off - n + 1 before the anchor
    cut = runs.withColumn("slices", F.least(F.lit(span), F.ceil(F.col("k") / SLICE).cast("int")))
    width = F.ceil(F.lit(float(span)) / F.col("slices")).cast("int")
    cut = cut.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    top, bottom = F.least(F.col("off"), (F.col("slice") + 1) * width - 1), F.greatest(F.col("off") - F.col("n") + 1, F.col("slice") * width)
    cut = cut.withColumn("first", F.col("lo") + F.col("off") - top).withColumn("m", top - bottom + 1).where("m > 0")
    per_text = by_text(cut, "h", "slice", "first", "m", "c", "lo", "n", "off")
    gram, distances = min(GRAM, window), _distances(window)
    marks = [name for side in _names(window) for name in side]
    names = ["h", "slice", "key", "first", "c", "bytes", "far", *marks]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), *[pa.int64()] * len(marks)]
    ddl = "h long, slice int, key binary, first long, c long, bytes binary, far int" + "".join(f", {m} long" for m in marks)

    def run(batches):
        for b in batches:
            out = [[] for _ in names]
            for key, text, found in zip(b[0].to_pylist(), b[1], b[2].to_pylist()):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for r in found:
                    at = r["lo"] + r["off"]
                    ahead = r["n"] - 1 - r["off"] + window - gram
                    # what no window of the run reaches tells nothing: 0
                    left = [_mark(raw[at - d : at]) if r["off"] >= d else 0 for d in distances]
                    right = [_mark(raw[at + gram : at + gram + d]) if ahead >= d else 0 for d in distances]
                    row = r["h"], r["slice"], key, r["first"], r["c"], raw[r["first"] : r["first"] + r["m"] + window - 1], at - r["first"]
                    for column, x in zip(out, (*row, *left, *right)):
                        column.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return docs.join(per_text.hint("shuffle_hash"), "key").select("key", "text", "runs").mapInArrow(run, ddl)


def _in_common(group: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Segments that have a mark (not 0) in common with another one of their group."""
    with np.errstate(over="ignore"):
        both = (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ mark.astype(np.uint64)
    _, place, count = np.unique(both, return_inverse=True, return_counts=True)
    return (count[place] > 1) & (mark != 0)


def _reach(group: np.ndarray, marks: list[np.ndarray], window: int) -> np.ndarray:
    """How far, at most, a segment has the bytes on one side of its anchor in common with another one:
    less than the first mark that it has to itself."""
    ends = [*_distances(window), window - min(GRAM, window) + 1]
    out = np.full(len(group), ends[0] - 1)
    for mark, end in zip(marks, ends[1:]):
        out = np.where(_in_common(group, mark), end - 1, out)
    return out


def _sorted_windows(segments: DataFrame, size: int, window: int) -> DataFrame:
    """key, lo, n: runs of repeated windows among the segments (of `size` bytes in all), shard by
    shard. A task streams its segments to a file, and what belongs to them to another one."""

    sides = _names(window)

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "rows")
            names = ["c", "far", *sides[0], *sides[1]]
            held = {x: [] for x in ("group", "windows", *names)}
            schema = None
            with pa.OSFile(path, "wb") as f:
                rows = None
                for b in batches:
                    schema = schema or b.schema
                    rows = rows or pa.ipc.new_stream(f, schema)
                    rows.write_batch(b)
                    # anchor and slice as one number: what collides is sorted in vain, no more
                    held["group"].append(b["h"].to_numpy() * 31 + b["slice"].to_numpy())
                    held["windows"].append(pc.binary_length(b["bytes"]).to_numpy() - window + 1)
                    for c in names:
                        held[c].append(b[c].to_numpy())
                if rows is None:
                    return
                rows.close()
            held = {x: np.concatenate(parts) for x, parts in held.items()}
            left, right = (_reach(held["group"], [held[x] for x in side], window) for side in sides)
            # a window that lies d before the anchor has d bytes to the left of it, the rest to the right
            far, beside = held["far"], window - min(GRAM, window)
            skip = far - np.minimum(far, left)
            windows = far - skip - np.maximum(far - held["windows"] + 1, beside - right) + 1
            picked = windows > 0
            skip, sizes = skip[picked], windows[picked] + window - 1
            shard, done, next_cut = Shard(folder), 0, zip(skip.tolist(), sizes.tolist())
            with pa.OSFile(path, "rb") as f, pa.ipc.open_stream(f) as rows:
                for b in rows:
                    for segment in b["bytes"].filter(pa.array(picked[done : done + b.num_rows])):
                        a, size = next(next_cut)
                        shard.add(segment.as_py()[a : a + size])
                    done += b.num_rows
            found, done, starts = shard.repeated(window, held["c"][picked]), 0, iter(skip.tolist())
            with pa.OSFile(path, "rb") as f, pa.ipc.open_stream(f) as rows:
                for b in rows:
                    mine, done = picked[done : done + b.num_rows], done + b.num_rows
                    b = b.select(["key", "first", "c"]).filter(pa.array(mine))
                    out = [[], [], []]
                    for key, first, w in zip(b[0], b[1].to_pylist(), b[2].to_pylist()):
                        at = next(found) + next(starts)
                        if len(at) and w == 1:  # those that stand for several are known to repeat
                            edge = np.flatnonzero(np.r_[True, np.diff(at) > 1])
                            out[0] += [key.as_py()] * len(edge)
                            out[1] += (first + at[edge]).tolist()
                            out[2] += np.diff(np.r_[edge, len(at)]).tolist()
                    yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["key", "lo", "n"])

    # shards of about SHARD bytes at any size of the input
    shards = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    return segments.repartition(shards, "h", "slice").mapInArrow(run, "key binary, lo long, n int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and the kept bytes (`kept`,
    binary) where asked for.

    A null text counts as empty. Texts are taken whole, however long. Texts shorter than the window lose nothing. Rows that repeat, id
    and text alike, repeat each other and all lose what is covered; a row whose id is null is
    treated like any other. An empty table gives an empty result. Extra columns are left out.
    """
    spark = docs.sparkSession
    gram = min(GRAM, window)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("key", row_key("id", "text"))
    runs, runs_path = materialize(runs_of(docs, byte_tokens, window, gram), "suffix-runs")
    classes, classes_path = materialize(classes_of(runs), "suffix-classes")
    known, _ = materialize(repeated(runs, classes), "suffix-known")
    asked, asked_path = materialize(in_question(classes), "suffix-asked")
    release(spark, runs_path, classes_path)
    segments, segments_path = materialize(_segments(docs, asked, window), "suffix-segments")
    size = segments.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    new, _ = materialize(_sorted_windows(segments, size, window), "suffix-new")
    release(spark, asked_path, segments_path)
    per_text = by_text(known.unionByName(new), "lo", "n")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for text, found in zip(b[1], b[2]):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, removed, spans = raw, 0, 0
                if found.is_valid:
                    v = found.values
                    lo, n = v.field("lo").to_numpy(), v.field("n").to_numpy()
                    gone = covered(len(raw), lo, lo + n + window - 1)
                    removed, spans = int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for column, x in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)):
                    column.append(x)
            cols = [b[0], *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())] + ([pa.array(out[4], pa.binary())] if keep_text else [])
            yield pa.record_batch(cols, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    joined = docs.join(per_text.hint("shuffle_hash"), "key", "left").select("id", "text", "runs")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
