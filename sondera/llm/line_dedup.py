"""Line dedup by a segment-partition edit join.

Lines that are equal, or of FUZZY_CHARS characters or more and within `max_edits` (2) edits, belong
to one class (closure of links); of each class the first occurrence, by (id, line number), stays.

Join: each line is cut into max_edits + 1 even segments. Whatever is within max_edits edits of it
holds one of the segments unchanged, at a place that the lengths bound. So each line is indexed
under (its length, segment number, segment) and probes, for every length from its own down to
max_edits less, the substrings that can match (multi-match-aware: those that leave enough edits for
both sides). A probe with an index entry of another line is a candidate. The tables that are
shuffled hold hashes only; the few lines in question get their texts from the documents afterwards.
Under one key candidates are compared block by block (BLOCK lines a side) and only links that join
two parts of the block leave it, so a key that many similar lines share makes no quadratic output.

Verification: edit distance in a band of 2 * max_edits + 1 diagonals, a bit vector a column, with an
early end as soon as no cell of the column can stay within max_edits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, read, release, row_key, spread
from .simhash import components

MAX_EDITS, MIN_CHARS, FUZZY_CHARS, BLOCK, SALT = 2, 8, 24, 128, 16
_SPACE = " \t\n\x0b\x0c\r"


def line_id(line: str) -> tuple[int, int]:
    """A line's 128 bits, as two signed numbers. The first half alone is what the index holds."""
    d = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"), 1)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, trimmed line) of the lines that take part."""
    return [(i, s) for i, line in enumerate(text.split("\n")) if len(s := line.strip(_SPACE)) >= MIN_CHARS]


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the even cut of n characters; the longer parts come last."""
    size, longer, at, out = n // parts, n % parts, 0, []
    for i in range(parts):
        m = size + (i >= parts - longer)
        out.append((at, m))
        at += m
    return out


def index_keys(line: bytes, n: int, max_edits: int) -> list[int]:
    """line: UTF-32, n characters."""
    digest = xxhash.xxh3_64_intdigest
    return [digest(line[4 * p : 4 * (p + m)], n * 8 + i) for i, (p, m) in enumerate(segments(n, max_edits + 1))]


def probe_keys(line: bytes, n: int, max_edits: int) -> list[int]:
    digest, out = xxhash.xxh3_64_intdigest, set()
    for other in range(max(FUZZY_CHARS, n - max_edits), n + 1):
        d = n - other
        for i, (p, m) in enumerate(segments(other, max_edits + 1)):
            lo, hi = max(0, p - i, p + d - (max_edits - i)), min(n - m, p + i, p + d + (max_edits - i))
            for q in range(lo, hi + 1):
                out.add(digest(line[4 * q : 4 * (q + m)], other * 8 + i))
    return list(out)


def _common(a: str, b: str, at_end: bool) -> int:
    """Length of the common beginning, or end, of two texts."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] if at_end else a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is k at most: bit-parallel over a band of 2k + 1 diagonals.

    reach[e] has bit j set if diagonal j - k can be at the current column with e edits."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    # what both begin and end with costs nothing; found by halving, not letter by letter
    a, b = a[(p := _common(a, b, False)) :], b[p:]
    p = _common(a, b, True)
    a, b = a[: len(a) - p], b[: len(b) - p]
    n, width = len(a), 2 * k + 1
    full = (1 << width) - 1
    reach = [0] * (k + 1)
    reach[0] = 1 << k
    for e in range(1, k + 1):
        reach[e] = reach[e - 1] | (reach[e - 1] << 1) & full
    for i in range(n):
        c, same = a[i], 0
        for j in range(max(0, i - k), min(len(b), i + k + 1)):
            if b[j] == c:
                same |= 1 << (j - i + k)
        new = [reach[0] & same]
        for e in range(1, k + 1):
            # match, substitute, delete from a (diagonal falls by one), insert from b (rises by one)
            x = (reach[e] & same) | reach[e - 1] | (reach[e - 1] >> 1) | (new[e - 1] << 1) & full
            new.append(x)
        reach = new
        if not reach[k]:
            return False
    return bool(reach[k] >> (len(b) - n + k) & 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """id, key, n, line, half of every line that takes part; docs: id, key, text."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, n, lid, half = [], [], [], []
            for i, t in enumerate(b[2].to_pylist()):
                for k, s in lines_of(t) if t else ():
                    at.append(i)
                    n.append(k)
                    for column, x in zip((lid, half), line_id(s)):
                        column.append(x)
            at = pa.array(at, pa.int64())
            yield pa.record_batch([b[0].take(at), b[1].take(at), pa.array(n, pa.int32()), pa.array(lid, pa.int64()), pa.array(half, pa.int64())], names=["id", "key", "n", "line", "half"])

    return spread(docs.select("id", "key", "text")).mapInArrow(run, f"id {kind}, key binary, n int, line long, half long")


def _keys(docs: DataFrame, max_edits: int, probes: bool) -> DataFrame:
    def run(batches):
        make = probe_keys if probes else index_keys
        for b in batches:
            k, lid, seen = [], [], set()
            for t in b[0].to_pylist():
                for _, s in lines_of(t) if t else ():
                    if len(s) >= FUZZY_CHARS and (i := line_id(s)[0]) not in seen:
                        seen.add(i)
                        got = make(s.encode("utf-32-le", "surrogatepass"), len(s), max_edits)
                        k += got
                        lid += [i] * len(got)
            yield pa.record_batch([pa.array(np.array(k, np.uint64).view(np.int64), pa.int64()), pa.array(lid, pa.int64())], names=["k", "line"])

    return spread(docs.select("text")).mapInArrow(run, "k long, line long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """line, node (the line's 128 bits), text of lines (line, half, key, n of one occurrence each)."""
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("line", "half", "n")).alias("lines"))

    def run(batches):
        for b in batches:
            lid, node, text = [], [], []
            for t, found in zip(b[0], b[1].to_pylist()):
                lines = t.as_py().split("\n")
                for x in found:
                    lid.append(x["line"])
                    node.append(x["line"].to_bytes(8, "big", signed=True) + x["half"].to_bytes(8, "big", signed=True))
                    text.append(lines[x["n"]].strip(_SPACE))
            yield pa.record_batch([pa.array(lid, pa.int64()), pa.array(node, pa.binary()), pa.array(text, pa.string())], names=["line", "node", "line_text"])

    return docs.join(per_text.hint("shuffle_hash"), "key").select("text", "lines").mapInArrow(run, "line long, node binary, line_text string").dropDuplicates(["node"])


def similar(docs: DataFrame, first: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """a, b: links between different lines (their 128 bits) whose closure is that of all pairs within
    max_edits. first: line, half, first (an occurrence) of every line."""
    spark = docs.sparkSession
    index, index_path = materialize(_keys(docs, max_edits, False), "lines-keys")
    by_key = index.groupBy("k").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    probe = _keys(docs, max_edits, True)
    hits, hits_path = materialize(probe.join(by_key, "k").where("low <> high or low <> line").select("k", "line"), "lines-probes")
    hits = hits.distinct()
    held, held_path = materialize(index.join(hits.select("k").distinct(), "k").select("k", "line").distinct(), "lines-index")
    sides = hits.withColumn("side", F.lit(1)).unionByName(held.withColumn("side", F.lit(0)))
    blocks = sides.groupBy("k").agg(*(F.ceil(F.sum(F.when(F.col("side") == s, 1).otherwise(0)) / BLOCK).cast("int").alias(f"b{s}") for s in (0, 1)))
    wanted = first.join(sides.select("line").distinct(), "line").select("line", "half", "first.key", "first.n")
    texts, texts_path = materialize(_texts(docs, wanted), "lines-texts")
    spread_out = sides.join(blocks, "k").join(texts, "line")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0")) - 1))
    spread_out = spread_out.withColumn("own", own).withColumn("other", other)
    cell = F.when(F.col("side") == 0, F.struct(F.col("own").alias("i"), F.col("other").alias("p"))).otherwise(F.struct(F.col("other").alias("i"), F.col("own").alias("p")))
    cells = spread_out.groupBy("k", cell.alias("cell")).agg(F.collect_set(F.struct("side", "node", "line_text")).alias("lines"))

    def run(batches):
        for b in batches:
            a, z = [], []
            for lines in b[0].to_pylist():
                left = [(x["node"], x["line_text"]) for x in lines if x["side"] == 0]
                right = [(x["node"], x["line_text"]) for x in lines if x["side"] == 1]
                parent: dict[bytes, bytes] = {}

                def root(i):
                    while parent.setdefault(i, i) != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for i, s in left:
                    for j, t in right:
                        if i != j and (p := root(i)) != (q := root(j)) and within(s, t, max_edits):
                            parent[max(p, q)] = min(p, q)
                            a.append(i)
                            z.append(j)
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(z, pa.binary())], names=["a", "b"])

    links, _ = materialize(cells.select("lines").mapInArrow(run, "a binary, b binary"), "lines-links")
    release(spark, index_path, hits_path, held_path, texts_path)
    return links


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS) -> DataFrame:
    """docs with the text's repeated lines removed; `n_lines` and `n_removed` are added.

    Lines are parted by line feeds and compared, whole however long, without the ASCII white space at
    their edges; those of fewer than MIN_CHARS characters, and blank ones, always stay. Null texts
    stay null. Rows that repeat, id and text alike, count as one and are treated alike. A null id
    comes first in the order of occurrences. An empty table gives an empty result. Columns named
    n_lines and n_removed are replaced; all others stay, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_removed")
    key, gone_at = fresh(docs.columns, "__key", "__gone")
    keyed = docs.withColumn(key, row_key(f"`{id_col}`", f"`{text_col}`"))
    slim = keyed.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{key}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    seen, seen_path = materialize(occurrences(slim), "lines-seen")
    at = F.struct("id", "key", "n")
    first, first_path = materialize(seen.groupBy("line", "half").agg(F.min(at).alias("first"), F.max(at).alias("last")), "lines-first")
    links = similar(slim, first, max_edits)
    roots, paths = components(links, "lines-classes")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    node = F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in ("line", "half"))))
    classes = first.withColumn("node", node).join(roots, "node", "left")
    several = classes.where("root is not null").groupBy("root").agg(F.min("first").alias("keeper"))
    repeats = classes.where("root is not null").select("line", "half", "root").join(several, "root").select("line", "half", "keeper")
    repeats = repeats.unionByName(classes.where("root is null and first <> last").select("line", "half", F.col("first").alias("keeper")))
    # a line that a third of all texts have is met in SALT tasks
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    repeats = repeats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    gone = salted.join(repeats, ["line", "half", "salt"]).where(~at.eqNullSafe(F.col("keeper")))
    per_text, _ = materialize(gone.groupBy(F.col("key").alias(key)).agg(F.collect_set("n").alias(gone_at)), "lines-gone")
    release(spark, seen_path, first_path, *paths)
    fields = docs.schema.fields

    def run(batches):
        for b in batches:
            texts, n_lines, n_removed = [], [], []
            for t, found in zip(b[text_col].to_pylist(), b[gone_at].to_pylist()):
                lines = t.split("\n") if t is not None else []
                n_lines.append(len(lines))
                n_removed.append(len(found) if found else 0)
                if found:
                    drop = set(found)
                    t = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if f.name == text_col else b[f.name] for f in fields]
            yield pa.record_batch([*cols, pa.array(n_lines, pa.int32()), pa.array(n_removed, pa.int32())], names=[*(f.name for f in fields), "n_lines", "n_removed"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_lines int, n_removed int"])
    return keyed.join(per_text.hint("shuffle_hash"), key, "left").drop(key).mapInArrow(run, ddl)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays, UTF-8) of every document."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
