"""Quality classifier from weak labels.

1. Labellers: overlapping heuristics vote good (1), bad (0) or abstain (-1) on each text.
2. Label model: with the votes independent given the class, expectation-maximisation estimates each
   labeller's accuracies and the class prior from the counts of vote patterns over all rows. The
   counts are summed on the executors; the driver sees one row a pattern, at most 3^labellers.
3. Scorer: posteriors of the label model label a bounded sample of rows, on which a linear model over
   hashed features (byte trigrams and binned shape features, feature hashing to 2^14) is trained by
   gradient descent on the logistic loss.
4. Every row is scored by the linear model over its whole text.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, spread

#: Hash bits of the scorer, rows it is trained on at most, passes over them, rate, L2.
BITS, MAX_TRAIN_DOCS, STEPS, RATE, L2 = 14, 4_000, 150, 2.0, 1e-4
THRESHOLD = 0.5
_MIX = np.uint32(0x9E3779B1)
_UPPER, _LETTER, _SYMBOL, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True  # parts of letters in UTF-8, nearly always
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = True

#: (name, statistic, bad from, good up to): at or over the first a vote for bad, at or below the
#: second one for good, no vote in between. Some can only tell what is bad: that a text has no table
#: rows in it does not make it a good one. They overlap and may disagree; the label model weighs them.
LABELLERS = (
    ("symbols", "symbol_share", 0.08, -1.0),
    ("capitals", "upper_share", 0.5, -1.0),
    ("repetition", "repeat_share", 0.6, -1.0),
    ("pipes", "pipe_share", 0.04, -1.0),
    ("long words", "mean_word", 12.0, -1.0),
    ("odd ends", "odd_ends", 0.3, 0.1),
    ("stutter", "stutter_share", 0.3, 0.1),
    ("letters", "unlettered", 0.3, 0.1),
    ("sentences", "sentence_gap", 0.5, 0.07),
    ("lines", "line_repeats", 0.5, -1.0),
)
STATS = ("symbol_share", "upper_share", "repeat_share", "pipe_share", "mean_word", "odd_ends", "stutter_share", "unlettered", "sentence_gap", "line_repeats")
#: Bins a unit of each statistic in the scorer's features.
_BINS = (20, 20, 20, 20, 1, 20, 20, 20, 20, 20)


def statistics(raw: bytes) -> tuple[float, ...]:
    """STATS of one whole text as UTF-8."""
    words = raw.split()
    if not words:
        return (0.0,) * len(STATS)
    b = np.frombuffer(raw, np.uint8)
    count = np.bincount(b, minlength=256)
    seen = len(b) - int(count[_SPACE].sum())
    letters = max(1, int(count[_LETTER].sum()))
    n = len(words)
    tails = {33, 35, 36, 37, 38, 42, 124}
    last = [w[-1] for w in words]
    odd = sum(x in tails for x in last)
    stutter = sum(map(operator.eq, words, words[1:]))
    ends = last.count(46) + last.count(63)
    lines = raw.split(b"\n")
    return (
        int(count[_SYMBOL].sum()) / seen,
        int(count[_UPPER].sum()) / letters if letters >= 20 else 0.0,
        # of distinct words among as many as Zipf would leave in a text of this length
        1 - min(1.0, len(set(words)) / n**0.8) if n > 20 else 0.0,
        int(count[124]) / seen,
        letters / n,
        odd / n,
        stutter / n,
        1 - min(1.0, letters / seen),
        # from a word in eleven, about what prose has; a few words tell nothing against a text
        abs(ends / n - 0.09) if n >= 30 else 0.0,
        1 - len(set(lines)) / len(lines),
    )


def votes_of(stats: tuple[float, ...]) -> list[int]:
    by = dict(zip(STATS, stats))
    return [0 if by[s] >= bad else 1 if by[s] <= good else -1 for _, s, bad, good in LABELLERS]


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior probability of `good` for each pattern (rows of -1, 0, 1), by EM.

    A labeller has three outcomes (abstain, bad, good) with probabilities of their own in each class:
    that a labeller keeps silent tells something too. Bad texts are of several kinds, of which most
    labellers see one: the bad class is a mixture with a kind for each labeller, so that labellers who
    see a rare kind are not outvoted by the silence of the others. EM starts from labellers that call
    bad what is good once in fifty times, and from kinds that their labeller calls bad mostly, which
    fixes which class is which."""
    m = patterns.shape[1]
    outcome = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    given = np.tile([0.45, 0.25, 0.3], (m + 1, m, 1))
    given[np.arange(m), np.arange(m)] = [0.1, 0.85, 0.05]
    given[m] = [0.49, 0.02, 0.49]
    prior, share = np.append(np.full(m, 0.2 / m), 0.8), np.zeros((len(patterns), m + 1))
    for _ in range(rounds):
        log = np.log(prior) + np.einsum("pio,kio->pk", outcome, np.log(given))
        share = np.exp(log - log.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        # half a pseudo-vote of each outcome
        given = np.einsum("pk,pio->kio", share * counts[:, None], outcome) + 0.5
        given /= given.sum(axis=2, keepdims=True)
        prior = (counts @ share + 1) / (counts.sum() + m + 1)
    return share[:, m]


def _feature_ids(raw: bytes, stats: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the whole text, and hashed bins of its statistics."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    b[(b >= 65) & (b <= 90)] = 65  # capitals alike, so that shapes count rather than words
    tri = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * _MIX >> np.uint32(32 - BITS) if len(b) > 2 else b[:0]
    bins = [np.uint32((1 << 24) + (i << 8) + min(20, int(x * _BINS[i]))) for i, x in enumerate(stats)]
    return tri, np.array(bins, np.uint32) * _MIX >> np.uint32(32 - BITS)


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse hashed features: (ids, values); trigrams share a weight of one, each bin has one."""
    tri, bins = _feature_ids(raw, statistics(raw))
    count = np.bincount(tri, minlength=1 << BITS).astype(np.float64)
    if len(tri):
        count *= 1 / np.sqrt((count * count).sum())
    np.add.at(count, bins, 1.0)
    ids = np.flatnonzero(count)
    return ids, count[ids]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Weights of the hashed linear scorer (bias last) by full gradient descent with momentum."""
    size = 1 << BITS
    ids = np.concatenate([r[0] for r in rows])
    vals = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    # both classes weigh the same
    weight = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    w, v = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(STEPS):
        z = np.bincount(owner, weights=w[ids] * vals, minlength=len(rows)) + w[-1]
        err = (1 / (1 + np.exp(-z)) - target) * weight
        grad = np.append(np.bincount(ids, weights=err[owner] * vals, minlength=size), err.sum()) + L2 * w
        v = 0.9 * v - RATE * grad
        w = w + v
    return w


def train(docs: DataFrame, text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS) -> np.ndarray:
    """Weights of the scorer. The label model sees every row; the scorer is fitted on a sample of
    about max_docs rows, by a hash of the text, in one task."""
    texts = spread(docs.select(F.col(text_col).alias("text")))

    def vote(batches):
        from collections import Counter

        seen = Counter()
        for b in batches:
            for t in b[0]:
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                seen[tuple(votes_of(statistics(raw)))] += 1
        yield pa.record_batch([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    got = texts.mapInArrow(vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    if not got:
        return np.zeros((1 << BITS) + 1)
    got.sort(key=lambda r: r["votes"])
    patterns, counts = np.array([r["votes"] for r in got]), np.array([r["n"] for r in got], float)
    post = dict(zip(map(tuple, patterns.tolist()), label_model(patterns, counts)))
    # shares of all 64 bits of a hash, so that a sample of the bounded size stays at any number of rows
    share = min(1.0, max_docs / counts.sum())
    # bad rows are rare; they are taken at a higher rate, to an equal number at most
    bad = sum(n for p, n in zip(patterns.tolist(), counts) if post[tuple(p)] < 0.5)
    share_bad = min(1.0, max_docs / max(bad, 1.0))
    bound = lambda x: min(int(x * 2.0**64) - (1 << 63), (1 << 63) - 1)
    bucket = F.xxhash64(F.coalesce("text", F.lit("")))
    pool = texts.where(bucket <= F.lit(bound(max(share, share_bad)))).withColumn("u", bucket)

    def sample(batches):
        for b in batches:
            t, p = [], []
            for text, u in zip(b[0], b[1].to_pylist()):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                good = post.get(tuple(votes_of(statistics(raw))), 0.5)
                if u <= bound(share if good >= 0.5 else share_bad):
                    ids, vals = features(raw)
                    t.append((ids, vals))
                    p.append(good)
            yield pa.record_batch(
                [pa.array([x[0] for x in t], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in t], pa.list_(pa.float32())), pa.array(p, pa.float64())],
                names=["ids", "vals", "target"],
            )

    def learn(batches):
        rows, target = [], []
        for b in batches:
            rows += [(i.values.to_numpy(), v.values.to_numpy().astype(float)) for i, v in zip(b[0], b[1])]
            target += b[2].to_pylist()
        w = fit(rows, np.array(target)) if rows else np.zeros((1 << BITS) + 1)
        yield pa.record_batch([pa.array([w.tolist()], pa.list_(pa.float64()))], names=["w"])

    picked = pool.mapInArrow(sample, "ids array<int>, vals array<float>, target double").repartition(1)
    weights = picked.mapInArrow(learn, "w array<double>").collect()
    return np.array(weights[0]["w"]) if weights else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", column: str = "quality_score") -> DataFrame:
    """docs with the probability that a text is good; 0 for null texts and those without words."""
    fields = [f for f in docs.schema.fields if f.name != column]

    def run(batches):
        for batch in batches:
            for b in slices(batch, text_col):
                out = []
                for t in b[text_col]:
                    raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                    if not raw.strip():
                        out.append(0.0)
                        continue
                    ids, vals = features(raw)
                    out.append(float(1 / (1 + np.exp(-np.clip(weights[ids] @ vals + weights[-1], -700, 700)))))
                yield pa.record_batch([*(b[f.name] for f in fields), pa.array(out, pa.float64())], names=[*(f.name for f in fields), column])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{column}` double"])
    return spread(docs.select(*(f"`{f.name}`" for f in fields))).mapInArrow(run, ddl)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, quality_score, keep of every row.

    Null, empty and blank texts score 0 and are not kept. Texts are scored whole, however long; a
    score at the threshold keeps. Repeated rows stay and score alike. An empty table gives an empty
    result. Extra columns are left out, also those named quality_score or keep.
    """
    small = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    scored = score(small, train(small), "text").drop("text")
    return scored.withColumn("keep", F.col("quality_score") >= threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"))
