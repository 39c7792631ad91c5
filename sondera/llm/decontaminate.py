"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every passage of every text (windows of two strides, one stride apart, so that any item lies whole
in one of them) is a query against the index of test items; all items whose BM25 score reaches
`theta` of their own best score (that of the item as its own query) are retrieved. Impacts are
stored as shares of that best score, so one threshold serves all items.

Block-max WAND: postings are in item order; the items' numbers are cut into blocks, and each term
has its largest impact in every block. A block whose maxima, summed over the passage's terms, stay
below theta is skipped whole, for all passages of a batch at once; in the others WAND moves the
terms' cursors to the pivot item and scores it only if its bound reaches theta.

Retrieved items are verified on the words: four fifths of the 5-word shingles of the question, and
of the answer, must stand in the passage. An item's answer is its last sentence (its last quarter if
it has only one), the question what comes before.

Document frequencies, the number of items and their mean length are of all items together, counted
by Spark. The items are then dealt into index blocks: by length (the passages that meet a block are
as long as its longest item, so one long item does not lengthen the passages of all others), and by
words, about BLOCK_WORDS at most. A block is one row of a written table and is broadcast by itself,
its size so bounded; small blocks share a pass over the texts. No number of items changes a score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, read, release, slices, spread

K1, B, THETA, SHINGLE, OVERLAP = 1.2, 0.75, 0.6, 5, 0.8
BLOCK_WORDS, BLOCKS, STRIDE, MEMO = 500_000, 100, 64, 1 << 19
_EDGE = re.compile(r"^\W+|\W+$")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def term(word: str) -> str:
    return word if word.isalpha() else _EDGE.sub("", word)


def terms_of(text: str) -> list[str]:
    return [t for w in text.lower().split() if (t := term(w))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [t for s in _SENTENCE.split(text.strip()) if (t := terms_of(s))]
    if len(parts) > 1:
        return [t for p in parts[:-1] for t in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def idf_of(items: int, holding: int) -> float:
    """Inverse document frequency of a word that `holding` of `items` test items hold."""
    return float(np.log(1 + (items - holding + 0.5) / (holding + 0.5)))


class ItemIndex:
    """Inverted index of a block of test items with impacts and block maxima. idf and mean are those
    of all items; where none are given the block is all there is."""

    def __init__(self, items: list[tuple[int, str]], idf: dict[str, float] | None = None, mean: float | None = None):
        self.ids = [i for i, _ in items]
        words = [terms_of(t) for _, t in items]
        self.vocab: dict[str, int] = {}
        for w in words:
            for t in w:
                self.vocab.setdefault(t, len(self.vocab))
        self.stride = max(STRIDE, max(map(len, words), default=0))
        n = len(items)
        if idf is None:
            mean = sum(map(len, words)) / max(1, n)
            idf = {t: idf_of(n, d) for t, d in Counter(t for w in words for t in set(w)).items()}
        size = -(-n // BLOCKS) if n else 1
        self.block_size = size
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.vocab]
        self.maxima = np.zeros((len(self.vocab) + 1, -(-n // size) if n else 1), np.float32)
        self.parts = []
        for i, w in enumerate(words):
            impact = {t: idf[t] * k * (K1 + 1) / (k + K1 * (1 - B + B * len(w) / mean)) for t, k in Counter(w).items()}
            best = sum(impact.values())
            for t, x in impact.items():
                v = self.vocab[t]
                self.postings[v][0].append(i)
                self.postings[v][1].append(x / best)
                self.maxima[v, i // size] = max(self.maxima[v, i // size], np.nextafter(np.float32(x / best), np.float32(2)))
            q, a = question_and_answer(items[i][1])
            self.parts.append((self._shingles(q), self._shingles(a)))

    def _shingles(self, words: list[str]) -> set[tuple[int, ...]]:
        v = [self.vocab[t] for t in words]
        n = min(SHINGLE, len(v))
        return {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()

    def wand(self, terms: list[int], block: int, theta: float) -> list[tuple[int, float]]:
        """(item, score) of the items of one block that reach theta for a set of terms."""
        end = (block + 1) * self.block_size
        lists = []
        for t in terms:
            ids, impacts = self.postings[t]
            p = bisect_left(ids, block * self.block_size)
            if p < len(ids) and ids[p] < end:
                lists.append([ids[p], p, float(self.maxima[t, block]), ids, impacts])
        out = []
        slack = theta - 1e-6
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for x in lists:
                bound += x[2]
                if bound >= slack:
                    pivot = x[0]
                    break
            if pivot < 0:
                break
            if lists[0][0] == pivot:
                score = sum(x[4][x[1]] for x in lists if x[0] == pivot)
                if score >= slack:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for x in lists:
                if x[0] < target:
                    x[1] = bisect_left(x[3], target, x[1])
                    x[0] = x[3][x[1]] if x[1] < len(x[3]) else end
            lists = [x for x in lists if x[0] < end]
        return out

    def overlaps(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Share of the question's and of the answer's shingles that stand in the passage."""
        words, out = passage.tolist(), []
        for part in self.parts[item]:
            if not part:
                out.append(1.0)
                continue
            n = len(next(iter(part)))
            have = set(zip(*(words[i:] for i in range(n))))
            out.append(len(part & have) / len(part))
        return out[0], out[1]


def search(texts: list[np.ndarray], index: ItemIndex, theta: float = THETA) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap), best passage for each; texts as
    vocabulary numbers, the number after the last for any other word."""
    other, stride = len(index.vocab), index.stride
    sizes = np.array([len(t) for t in texts], np.int64)
    cells = -(-sizes // stride)
    first = np.cumsum(cells) - cells
    total = int(cells.sum())
    if not total or not other:
        return []
    words = np.concatenate(texts).astype(np.int64)
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cell = np.repeat(first, sizes) + at // stride
    pairs = np.unique((cell * (other + 1) + words)[words < other])
    cell, word = pairs // (other + 1), pairs % (other + 1)
    bound = np.zeros((total + 1, index.maxima.shape[1]), np.float32)
    if len(pairs):
        edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        bound[cell[edge]] = np.add.reduceat(index.maxima[word], edge, axis=0)
    owner = np.repeat(np.arange(len(texts)), cells)
    # a passage is a cell and the next one of the same text
    follows = np.zeros(total, bool)
    follows[:-1] = owner[1:] == owner[:-1]
    bound[:total][follows] += bound[1:][follows]
    cuts = np.searchsorted(cell, np.arange(total + 2))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for c, block in np.argwhere(bound[:total] >= theta - 1e-5).tolist():
        terms = word[cuts[c] : cuts[c + 1 + int(follows[c])]]
        most = index.maxima[terms, block]
        terms, most = terms[most > 0], most[most > 0]
        if follows[c]:  # a word of both cells counts once
            order = np.argsort(terms)
            terms, most = terms[order], most[order]
            new = np.ones(len(terms), bool)
            np.not_equal(terms[1:], terms[:-1], out=new[1:])
            terms, most = terms[new], most[new]
        if most.sum() < theta - 1e-5:
            continue
        for item, score in index.wand(terms.tolist(), block, theta):
            text = int(owner[c])
            a = (c - int(first[text])) * stride
            q, r = index.overlaps(item, texts[text][a : a + 2 * stride])
            if q >= OVERLAP and r >= OVERLAP and score > best.get((text, item), (0.0,))[0]:
                best[text, item] = (score, q, r)
    return [(*k, *v) for k, v in sorted(best.items())]


def index_blocks(items: DataFrame, item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """block, ids (strings of the items' numbers), texts, idf (of the block's words), mean: the table
    of index blocks, and the paths to release. Items without words are left out; equal rows are one."""
    spark = items.sparkSession
    kind = items.schema[item_id].dataType.simpleString()

    def count(batches):
        for b in batches:
            words = [terms_of(t) if t else [] for t in b[1].to_pylist()]
            yield pa.record_batch([b[0], b[1].cast(pa.string()), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], names=["i", "t", "n", "terms"])

    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).dropDuplicates(["i", "t"])
    rows, rows_path = materialize(rows.mapInArrow(count, f"i {kind}, t string, n long, terms array<string>").where("n > 0"), "items-words")
    total = rows.agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean"), F.sum("n").alias("words")).first()
    # lengths up to a stride are one class, then one for each doubling
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / STRIDE))).cast("int")
    sizes = rows.groupBy(level.alias("level")).agg(F.ceil(F.sum("n") / (block_words * 0.8)).cast("int").alias("parts"))
    dealt = rows.withColumn("level", level).join(F.broadcast(sizes), "level").withColumn("part", F.pmod(F.xxhash64("i", "t"), F.col("parts")))
    dealt = dealt.select(F.format_string("%d-%d", "level", "part").alias("block"), "i", "t", "terms")
    dealt, dealt_path = materialize(dealt, "items-dealt")
    df = dealt.select("block", F.explode("terms").alias("term"))
    holding = df.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    per_block = df.distinct().join(holding, "term").groupBy("block").agg(F.collect_list("term").alias("terms"), F.collect_list("d").alias("d"))
    texts = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("items"))
    blocks = texts.join(per_block, "block").select("block", "items", "terms", "d", F.lit(total["items"]).cast("long").alias("all_items"), F.lit(total["mean"]).cast("double").alias("mean"))
    blocks, blocks_path = materialize(blocks, "items-blocks")
    release(spark, rows_path, dealt_path)
    return blocks, [blocks_path]


def _search_blocks(rows: list[dict], batches, id_col: str, item_type, theta: float):
    """Hits of all texts of some batches in some index blocks."""

    class Number(dict):
        """Word -> number in a block's vocabulary, its size for any other word, -1 for none."""

        def __init__(self, vocab):
            super().__init__()
            self.vocab = vocab

        def __missing__(self, word):
            if len(self) > MEMO:
                self.clear()
            bare = term(word)
            self[word] = v = self.vocab.get(bare, len(self.vocab)) if bare else -1
            return v

    indexes = []
    for row in rows:
        idf = {t: idf_of(row["all_items"], d) for t, d in zip(row["terms"], row["d"])}
        index = ItemIndex([(x["i"], x["t"]) for x in row["items"]], idf, row["mean"])
        indexes.append((index, Number(index.vocab)))
    for batch in batches:
        for b in slices(batch, "text"):
            words = [t.lower().split() if t else [] for t in b["text"].to_pylist()]
            for index, number in indexes:
                texts = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in words]
                hits = search([v[v >= 0] for v in texts], index, theta)
                ids = b[id_col].take(pa.array([h[0] for h in hits], pa.int64()))
                cols = [ids, pa.array([index.ids[h[1]] for h in hits], item_type)]
                yield pa.record_batch([*cols, *(pa.array([h[i] for h in hits], pa.float64()) for i in (2, 3, 4))], names=[id_col, "item_id", "score", "question_overlap", "answer_overlap"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", theta: float = THETA, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, item_id, score, question_overlap, answer_overlap: one row for each text (row) and test
    item that stands in it. Item ids may be of any type.

    Null and empty texts and items match nothing. Texts are searched whole, however long. Repeated
    rows give a row each; repeated items count once. An empty table on either side gives an empty
    result. Extra columns are left out.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)
    ddl = f"`{id_col}` {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    blocks, _ = index_blocks(items, item_id, item_text, block_words)
    docs = spread(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text")))
    found = spark.createDataFrame([], ddl)
    sizes = blocks.select("block", F.aggregate("items", F.lit(0), lambda n, x: n + F.size(F.split(x["t"], r"\s+"))).alias("n")).orderBy("block").collect()
    passes, room = [], 0
    for r in sizes:
        if r["n"] > room:
            passes.append([])
            room = block_words
        passes[-1].append(r["block"])
        room -= r["n"]
    for names in passes:
        sent = spark.sparkContext.broadcast([r.asDict(recursive=True) for r in blocks.where(F.col("block").isin(names)).orderBy("block").collect()])
        found = found.unionByName(docs.mapInArrow(lambda batches, sent=sent: _search_blocks(sent.value, batches, id_col, item_type, theta), ddl))
    return found


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
