"""Near copies: rows whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more.

SimHash comes first: op9's fingerprints, its index of positional bytes and its links of four bits at
most name candidates, which are verified on their whole shingle sets and joined to groups. That
settles near copies that differ in a few words. A 64-bit fingerprint can't tell the rest: at
similarity 0.8 about 10 bits differ and often 16, and an index for so many is no smaller than all
pairs. So rows of different groups are candidates, too, where they share one of 32 bands of four
min-hashes, which a pair at similarity 0.8 exactly misses with probability 5e-8 (nearer ones less).
They are verified alike.

Rows of one shingle set are collapsed first. A band's rows are compared with the band's least row,
which settles a large group of near copies, and after that, where a band still holds several
components, all its rows across components. Bands of up to MEMBERS rows name these pairs. Larger ones
name none: their rows, joined to groups over the bands that they share, are cut into blocks, and for
each pair of blocks one task counts what all sets have in common and lets a spanning forest of the
links out. So no list grows with a group, and components equal those of all pairs of every band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, release, row_key, spread
from .simhash import components, fingerprint, links

SHINGLE_WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, BAND_ROWS = 32, 4
MEMBERS, CELL, SALT = 64, 128, 16
_BLOCK, _COLUMNS = 1024, 1 << 15
_A, _B = (np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(i) for i in (1, 0))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of lower-cased words; one of all its words where
    they are fewer, none for a null text or one without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    k = max(1, len(w) - words + 1)
    starts = [0, *(ends[: k - 1] + 1).tolist()]
    stops = ends[min(words, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / n if (n := len(a) + len(b) - common) else 1.0


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (hashes[at : at + _BLOCK, None] * _A + _B).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)


def _signatures(batches):
    for b in batches:
        nodes, keys, prints = [], [], []
        for t in b[2]:
            h = shingles(t.as_py())
            nodes.append(xxhash.xxh3_128_digest(h.tobytes(), SEED))
            keys.append(bands(h).view(np.int64))
            prints.append(fingerprint(t.as_py()))
        keys = pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(keys) + 1, BANDS), pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)]), pa.int64()))
        yield pa.record_batch([b[0], b[1], pa.array(nodes, pa.binary()), keys, pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())], names=["id", "row", "node", "keys", "fp"])


def _sets(batches):
    for b in batches:
        yield pa.record_batch([b[0], pa.array([shingles(t.as_py()).tobytes() for t in b[1]], pa.binary())], names=["node", "hashes"])


def _verified(batches):
    for b in batches:
        near = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= SIMILARITY for x, y in zip(b[2], b[3])]
        yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _crossing(batches):
    """All pairs of a band's rows in different components but those with its least row."""
    for b in batches:
        for members in b[0]:
            pairs = sorted(zip(members.values.field("node").to_pylist(), members.values.field("root").to_pylist()))[1:]
            number = {r: i for i, r in enumerate({r for _, r in pairs})}
            root, node = np.array([number[r] for _, r in pairs], np.int64), [n for n, _ in pairs]
            for i in range(len(node) - 1):
                other = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
                if len(other):
                    yield pa.record_batch([pa.array([node[i]] * len(other), pa.binary()), pa.array([node[j] for j in other.tolist()], pa.binary())], names=["a", "b"])


def in_common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of x has in common with each of y."""
    every, place = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in (*x, *y)])
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(x), len(y)), np.float64)
    for at in range(0, len(every), _COLUMNS):
        i, j = np.searchsorted(place, [at, at + _COLUMNS])
        held = np.zeros((len(x) + len(y), min(_COLUMNS, len(every) - at)), np.float32)
        held[row[i:j], place[i:j] - at] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out


def _cell_links(batches):
    """Spanning links between the rows of two blocks, or within one."""
    for b in batches:
        links = []
        for i, j, rows in zip(b[0].to_pylist(), b[1].to_pylist(), b[2]):
            rows = [(r["own"], r["node"], np.frombuffer(r["hashes"], np.uint64)) for r in rows.as_py()]
            x, y = [r for r in rows if r[0] == i], [r for r in rows if r[0] == j]
            common = in_common([r[2] for r in x], [r[2] for r in y])
            sizes = [np.array([len(r[2]) for r in z], float) for z in (x, y)]
            near = common >= SIMILARITY * (sizes[0][:, None] + sizes[1] - common) - 1e-9
            if i == j:
                near = np.triu(near, 1)
            parent: dict[bytes, bytes] = {}

            def root(n, parent=parent):
                while parent.setdefault(n, n) != n:
                    parent[n] = parent[parent[n]]
                    n = parent[n]
                return n

            for k, m in zip(*map(np.ndarray.tolist, np.nonzero(near))):
                if (p := root(x[k][1])) != (q := root(y[m][1])):
                    parent[max(p, q)] = min(p, q)
                    links.append((x[k][1], y[m][1]))
        yield pa.record_batch([pa.array([z[n] for z in links], pa.binary()) for n in (0, 1)], names=["a", "b"])


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: rows of `nodes` (node, fp) that SimHash links: each fingerprint's rows with its least one,
    and the least ones of fingerprints that op9's index links."""
    prints = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    # a fingerprint that a third of all rows share is met in SALT tasks
    salted = nodes.select("fp", "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    same = salted.join(prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["fp", "salt"]).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    linked = links(prints.select("fp"))
    heads = [prints.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in ("a", "b")]
    far = linked.join(heads[0], "a").join(heads[1], "b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    return same.unionByName(far).distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies: that of the least id (nulls last), then of the
    least hash of the row. All columns stay.

    Rows are told apart by all their columns: a null or repeated id neither joins rows nor loses
    them. Null texts and those without words are copies of one another. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    columns = docs.columns
    (row,) = fresh(columns, "__row")
    docs = docs.withColumn(row, row_key(*(f"`{c}`" for c in columns)))
    rows, rows_path = materialize(spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(row).alias("row"), F.col(text_col))).mapInArrow(_signatures, "id long, row binary, node binary, keys array<long>, fp long"), "near-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    nodes, nodes_path = materialize(rows.groupBy("node").agg(first, F.first("keys").alias("keys"), F.min("fp").alias("fp")), "near-nodes")
    keyed = spread(nodes.select("node", "keys")).select("node", F.explode("keys").alias("key"))
    heads, heads_path = materialize(keyed.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a"), "near-heads")
    # a band that a third of all rows share is met in SALT tasks
    met = keyed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    lists, lists_path = materialize(met.join(heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["key", "salt"]).select("key", "a", "node"), "near-lists")
    named, named_path = materialize(simhash_pairs(nodes), "near-simhash")
    paths = [rows_path, nodes_path, heads_path, lists_path, named_path]
    listed = lists.select("node").unionByName(named.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    # one row's text stands for all rows of its shingle set
    texts = docs.join(listed.join(nodes, "node").select("node", F.col("first.row").alias(row)), row).select("node", text_col).dropDuplicates(["node"])
    sets, sets_path = materialize(texts.mapInArrow(_sets, "node binary, hashes binary"), "near-sets")
    paths.append(sets_path)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        edges, path = materialize(both.select("a", "b", "x", "y").mapInArrow(_verified, "a binary, b binary"), "near-edges")
        paths.append(path)
        return edges

    def rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
        return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    edges = verify(named)
    roots, more = components(edges, "near-links")
    paths += more
    # rows that SimHash has joined already need no second look
    star = lists.select("a", F.col("node").alias("b")).where("a <> b").distinct()
    for x in ("a", "b"):
        star = star.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    star = star.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    edges = edges.unionByName(verify(star))
    roots, more = components(edges, "near-links")
    paths += more
    members, members_path = materialize(rooted(lists.select("key", "node"), roots), "near-members")
    paths.append(members_path)
    apart = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "a", "n")
    apart, apart_path = materialize(apart, "near-apart")
    few = members.join(apart.where(F.col("n") <= MEMBERS), "key").groupBy("key").agg(F.collect_list(F.struct("root", "node")).alias("members"))
    crossing = few.select("members").mapInArrow(_crossing, "a binary, b binary")
    edges = edges.unionByName(verify(crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    many = apart.where(F.col("n") > MEMBERS).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dense = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(many, ["key", "salt"]).select(F.col("a").alias("u"), "node").distinct()
    dense, dense_path = materialize(dense, "near-dense")
    paths += [apart_path, dense_path]
    if not dense.isEmpty():
        groups, more = components(dense.select(F.col("u").alias("a"), F.col("node").alias("b")), "near-groups")
        paths += more
        grouped = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).join(sets, "node")
        sizes = groups.groupBy("root").agg(F.ceil((F.count(F.lit(1)) + 1) / CELL).cast("int").alias("blocks"))
        dealt = grouped.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = dealt.groupBy("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("own", "node", "hashes")).alias("rows"))
        links, links_path = materialize(cells.select("i", "j", "rows").mapInArrow(_cell_links, "a binary, b binary"), "near-edges")
        paths.append(links_path)
        edges = edges.unionByName(links)
    roots, more = components(edges, "near-links")
    paths += more
    kept, _ = materialize(rooted(nodes, roots).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)), "near-kept")
    release(spark, *paths)
    return docs.join(kept, row, "left_semi").dropDuplicates([row]).select(*(f"`{c}`" for c in columns))
