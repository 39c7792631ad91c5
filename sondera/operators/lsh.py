"""Near-duplicate pairs of 64-bit perceptual hashes by banding, and the hash itself."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hamming64
from .order import covering_width


#: Rows of a block that meet the other block at once.
_ROWS = 64


def near_pairs(hashes: DataFrame, max_dist: int = 6, bands: int = 8, bits: int = 64, max_bucket: int | None = None, block: int = 4096) -> DataFrame:
    """a, b, distance for ids a < b that differ in max_dist bits at most and share a band.

    With more bands than max_dist every such pair shares one, so none is lost; bits that are left over
    go to the last band. A bucket of over `block` ids is cut into blocks, whose pairs are cells of
    their own. With max_bucket, buckets of more ids are skipped instead: a loss of recall that some
    definitions have, and keep for comparison."""
    width = bits // bands
    kind = hashes.schema["id"].dataType.simpleString()
    rows = hashes.where(F.col("id").isNotNull()).select("id", "hash", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    last = (F.lit(1).cast("long") * -1) if bits - width * (bands - 1) >= 64 else F.lit((1 << (bits - width * (bands - 1))) - 1)
    rows = rows.withColumn("key", F.expr(f"shiftrightunsigned(hash, band * {width})").bitwiseAND(F.when(F.col("band") == bands - 1, last).otherwise(F.lit((1 << width) - 1))))
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if max_bucket is not None:
        sizes = sizes.where(F.col("k") <= max_bucket)
    rows = rows.join(sizes.select("band", "key", F.ceil(F.col("k") / block).cast("int").alias("blocks")), ["band", "key"])
    # by a bucket's blocks the rows are packed, and each pair of blocks is a cell
    packed = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).groupBy("band", "key", "blocks", "own").agg(F.collect_list(F.struct("id", "hash")).alias("rows"))
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.groupBy("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.max(F.when(F.col("own") <= F.col("other"), F.col("rows"))).alias("x"), F.max(F.when(F.col("own") > F.col("other"), F.col("rows"))).alias("y")
    )
    # a block that holds no row makes a cell of one side
    cells = cells.where(F.col("x").isNotNull() & ((F.col("i") == F.col("j")) | F.col("y").isNotNull()))
    # the first band that a pair shares names it, unless that bucket may be skipped; rows that repeat are left to distinct
    return cells.select("band", "x", "y").mapInArrow(_cell_pairs(max_dist, width, max_bucket is None), f"a {kind}, b {kind}, distance int").distinct()


def _cell_pairs(max_dist: int, width: int, first: bool):
    """Near pairs of each cell's two blocks, or within one; with `first` only those that no band before shares."""

    def run(batches):
        for batch in batches:
            for band, x, y in zip(batch[0].to_pylist(), batch[1], batch[2]):
                ids, hashes = ([s.values.field(c).to_numpy(zero_copy_only=False) for s in ((x, y) if y.is_valid else (x,))] for c in ("id", "hash"))
                hashes = [h.view(np.uint64) for h in hashes]
                kind = x.values.field("id").type
                for at in range(0, len(ids[0]), _ROWS):
                    differ = hashes[0][at : at + _ROWS, None] ^ hashes[-1][None, :]
                    i, j = np.nonzero(np.bitwise_count(differ) <= max_dist)
                    x_id, y_id, d = ids[0][at + i], ids[-1][j], differ[i, j]
                    keep = x_id != y_id if y.is_valid else x_id < y_id
                    if first:
                        for k in range(band):
                            keep &= (d >> np.uint64(k * width)) & np.uint64((1 << width) - 1) != 0
                    x_id, y_id, d = x_id[keep], y_id[keep], d[keep]
                    yield pa.record_batch([pa.array(np.minimum(x_id, y_id), kind), pa.array(np.maximum(x_id, y_id), kind), pa.array(np.bitwise_count(d).astype(np.int32))], names=["a", "b", "distance"])

    return run


def covered_pairs(hashes: DataFrame, max_dist: int = 6, bits: int = 64, block: int = 500, n: int | None = None) -> DataFrame:
    """a, b, distance for ids a < b that differ in max_dist bits at most: all of them.

    Hashes are cut into max_dist + t groups of bits. Two that are near differ in max_dist groups at
    most, so they agree in t groups at least, and every choice of t groups is a key: near pairs meet
    in one key at least. t follows from the number of hashes (n; counted if not given): keys are as
    wide as it takes for chance meetings to be few. A pair counts in the first key it shares alone, told by
    its own bits, so nothing is made distinct. Keys of over `block` ids are cut into blocks.
    """
    n = hashes.count() if n is None else n
    groups, taken = covering_width(max(1, n), max_dist, bits)
    edges = [bits * g // groups for g in range(groups + 1)]
    mask = lambda g: ((1 << edges[g + 1]) - (1 << edges[g])) - (1 << 64 if edges[g + 1] == 64 else 0)  # noqa: E731  signed
    union = lambda gs: F.lit(sum(mask(g) for g in gs)).cast("long")
    sets = list(combinations(range(groups), taken))
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("set"), F.col("hash").bitwiseAND(union(s)).alias("key")) for i, s in enumerate(sets))))
    rows = hashes.select("id", "hash", keys.alias("k")).select("id", "hash", "k.*")
    sizes = rows.groupBy("set", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = rows.join(sizes.select("set", "key", F.ceil(F.col("c") / block).cast("int").alias("blocks")), ["set", "key"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = rows.withColumn("i", F.col("own")).withColumn("j", F.explode(every)).alias("a")
    b = rows.withColumn("j", F.col("own")).withColumn("i", F.explode(every)).alias("b")
    pairs = a.join(b, [*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("set", "key", "i", "j")), F.col("a.id") < F.col("b.id")])
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.set").alias("set"), F.col("a.hash").bitwiseXOR(F.col("b.hash")).alias("x"))
    # the first key that two hashes share is of their first `taken` equal groups
    equal = F.filter(F.array(*(F.when(F.col("x").bitwiseAND(union([g])) == 0, F.lit(g)) for g in range(groups))), lambda g: g.isNotNull())
    chosen = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in sets)), F.col("set") + 1)
    near = pairs.withColumn("distance", F.bit_count("x")).where((F.col("distance") <= max_dist) & (F.slice(equal, 1, taken) == chosen))
    return near.select("a", "b", "distance")


def sign_hash(vec: str = "embedding", bits: int = 64):
    """A 64-bit hash of a vector: bit i is set where component i is positive."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.when(F.try_element_at(F.col(vec), (i + 1).cast("int")) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))),
    )


def phash64(pixels: np.ndarray) -> np.ndarray:
    """Perceptual hashes (63 bits) of images (n x 32 x 32): low cosine terms but the first, row by row,
    against their median."""
    from .images import dct_matrix

    m = dct_matrix(32)[:8]
    low = np.einsum("ki,nij,lj->nkl", m, np.asarray(pixels, float).reshape(-1, 32, 32), m).reshape(-1, 64)[:, 1:]
    bits = low > np.median(low, axis=1)[:, None]
    return (bits.astype(np.int64) << np.arange(63)).sum(axis=1)


def phash(pixels: str):
    """Column: the hash of arrays of 1,024 pixels, a batch of images at a time."""

    @F.pandas_udf("long")
    def hashed(v: pd.Series) -> pd.Series:
        return pd.Series(phash64(np.stack(v)) if len(v) else np.empty(0, np.int64))

    return hashed(pixels)
