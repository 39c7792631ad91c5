"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language has a probability for every piece. A word
(with its leading word mark) is scored by the forward algorithm, the sum over all segmentations into
pieces of the product of their probabilities; a text's likelihood is the product over its words.
Characters that no piece covers fall back on one shared unknown probability.

Training is expectation-maximisation on a bounded sample of the labelled rows: of each language its
rows of smallest hash, the same share of each but FLOOR_DOCS at least where it has them, about
MAX_TRAIN_DOCS in all (and the floors beside). The expected number of uses of each piece is summed over all
segmentations by the forward-backward algorithm, on the executors, from (language, word, count)
rows; the driver only sees piece counts, at most the vocabulary times the languages.

Every letter piece of the vocabulary is used, and words are scored whole: forward sums are scaled at
each character, so no word is too long for them. Scoring reads whole texts. A word's scores are computed once a task and kept in a bounded memo.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, release, slices, spread

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_TRAIN_DOCS, FLOOR_DOCS, ROUNDS, SMOOTHING = 5_000, 200, 2, 0.01
#: Words in the memo of a task.
MEMO = 1 << 19
_NOT_SPACE = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_UNKNOWN = 1e-7
#: Characters that are scored at once, so that a word of any length needs bounded memory.
_AT_ONCE = 1 << 18


def letter_runs(token: str) -> list[str]:
    """Runs of letters (str.isalpha); signs that regular expressions take for word characters, as
    ½, ² or ⅷ, are none."""
    if token.isalpha():
        return [token]
    return [w for run in _NOT_SPACE.findall(token) for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


@lru_cache(2)
def pieces(path: str = VOCABULARY) -> dict[str, int]:
    """Piece -> number, of the letters-only pieces in lower case."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i):
            continue
        p = sp.id_to_piece(i).lower()
        if p == _MARK or p.removeprefix(_MARK).isalpha():
            out.setdefault(p, len(out))
    return out


class Lookup:
    """Piece numbers of all substrings of many words at once: two hash tables over the vocabulary,
    the second for what collides in the first, and a list for the few that collide in both."""

    BITS, BASE = 20, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: dict[str, int]):
        self.n, self.longest = len(vocab), max(map(len, vocab), default=1)
        keys = {self.key(p): i for p, i in vocab.items()}
        assert len(keys) == len(vocab), "two pieces have one key"
        self.tables = []
        for mult in (0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7):
            at = {k: (k * mult & 0xFFFFFFFFFFFFFFFF) >> (64 - self.BITS) for k in keys}
            slot = {at[k]: k for k in keys}
            table, held = np.full(1 << self.BITS, -1, np.int32), np.zeros(1 << self.BITS, np.uint64)
            for place, k in slot.items():
                table[place], held[place] = keys[k], k
            self.tables.append((np.uint64(mult), table, held))
            keys = {k: i for k, i in keys.items() if slot[at[k]] != k}
        assert not keys, "pieces are left without a slot"

    @classmethod
    def key(cls, piece: str) -> int:
        k = 0
        for c in piece:
            k = (k * int(cls.BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return k

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, -1, np.int32)
        for mult, table, held in self.tables:
            at = (keys * mult) >> np.uint64(64 - self.BITS)
            hit = held[at] == keys
            out = np.where(hit & (out < 0), table[at], out)
        return out

    def substrings(self, words: list[str]) -> tuple[np.ndarray, int]:
        """ids[w, s, l - 1]: the piece at s of length l of each of some words of one length; -1 is
        none, and the number after the last piece stands for an unknown character."""
        n = len(words[0])
        chars = np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        ids = np.full((len(words), n, min(n, self.longest)), -1, np.int32)
        key = np.zeros_like(chars)
        for length in range(1, min(self.longest, n) + 1):
            key = key[:, : n - length + 1] * self.BASE + chars[:, length - 1 :]
            ids[:, : n - length + 1, length - 1] = self.find(key)
        one = ids[:, :, 0]
        one[one < 0] = self.n
        return ids, n


@lru_cache(2)
def lookup(path: str = VOCABULARY) -> Lookup:
    return Lookup(pieces(path))


def _by_length(items: list[str], most: int = 1 << 13):
    order = sorted(range(len(items)), key=lambda i: len(items[i]))
    at = 0
    while at < len(order):
        end = at
        n = len(items[order[at]])
        while end < len(order) and end - at < max(1, min(most, _AT_ONCE // n)) and len(items[order[end]]) == n:
            end += 1
        yield np.array(order[at:end])
        at = end


def score_parts(items: list[str], table: Lookup, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each marked word under each language (columns): the forward sum over all
    segmentations. prob: (pieces + 1, languages); the last row is the unknown character."""
    padded = np.vstack([prob, np.zeros((1, prob.shape[1]))])  # -1: no piece
    out = np.zeros((len(items), prob.shape[1]))
    for rows in _by_length(items):
        ids, n = table.substrings([items[i] for i in rows])
        # only the last `longest` sums are held, all scaled to the greatest of them
        reach = min(table.longest, n)
        alpha, log_scale = [np.ones((len(rows), prob.shape[1]))], np.zeros((len(rows), prob.shape[1]))
        some = (ids >= 0).any(axis=0)
        for e in range(1, n + 1):
            new = np.zeros_like(alpha[0])
            for length in range(1, min(reach, e) + 1):
                if some[e - length, length - 1]:
                    new += alpha[-length] * padded[ids[:, e - length, length - 1]]
            alpha = [*alpha[-reach + 1 :], new] if reach > 1 else [new]
            if e % 8 == 0:
                top = np.maximum.reduce(alpha)
                alpha = [x / top for x in alpha]
                log_scale += np.log(top)
        out[rows] = np.log(alpha[-1]) + log_scale
    return out


def expected_uses(items: list[str], lang: np.ndarray, count: np.ndarray, table: Lookup, prob: np.ndarray) -> np.ndarray:
    """(pieces + 1, languages): expected uses of each piece over marked words, each under its own
    language and taken `count` times, by forward-backward."""
    padded = np.vstack([prob, np.zeros((1, prob.shape[1]))])
    sums = np.zeros(padded.size)
    for rows in _by_length(items):
        ids, n = table.substrings([items[i] for i in rows])
        langs, some = lang[rows], (ids >= 0).any(axis=0)
        steps = [(s, k) for s in range(n) for k in range(1, min(table.longest, n - s) + 1) if some[s, k - 1]]
        p = {(s, k): padded[ids[:, s, k - 1], langs] for s, k in steps}
        # a[e] is in units of exp(scale[e]): each place has a scale of its own, b the same with what follows
        a, b = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
        up = np.zeros((n + 1, len(rows)))
        a[0], b[n] = 1, 1
        into, out_of = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for s, k in steps:
            into[s + k].append((s, k))
            out_of[s].append((s, k))
        for e in range(1, n + 1):
            base = np.max([up[s] for s, _ in into[e]], axis=0)
            a[e] = sum(a[s] * p[s, k] * np.exp(up[s] - base) for s, k in into[e])
            up[e] = base + np.log(a[e])
            a[e] = 1
        for s in range(n - 1, -1, -1):
            # b times what a[s] stands for, over the whole word's sum: the posterior of a cut at s
            b[s] = sum(p[s, k] * b[s + k] * np.exp(up[s] - up[s + k]) for s, k in out_of[s])
        scale = count[rows]
        for s, k in steps:
            at = np.where(ids[:, s, k - 1] < 0, len(prob), ids[:, s, k - 1]).astype(np.int64) * prob.shape[1] + langs
            sums += np.bincount(at, weights=p[s, k] * b[s + k] * np.exp(up[s] - up[s + k]) * scale, minlength=sums.size)
    return sums.reshape(padded.shape)[:-1]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY, max_docs: int = MAX_TRAIN_DOCS, floor_docs: int = FLOOR_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities (pieces + 1, languages) and log priors, from labelled rows."""
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    vocab = pieces(path)
    if not langs:
        return [], np.zeros((len(vocab) + 1, 0)), np.zeros(0)
    # the sample: of each language the hashes up to a bound of its own, compared in all 64 bits
    share = min(1.0, max_docs / sum(sizes.values()))
    bound = F.lit(None).cast("long")
    for x, n in sizes.items():
        of_lang = min(1.0, max(share, floor_docs / n))
        bound = F.when(F.col("lang") == F.lit(x), F.lit(min(int(of_lang * 2.0**64) - (1 << 63), (1 << 63) - 1)).cast("long")).otherwise(bound)
    sample = rows.where(F.xxhash64("text") <= bound)

    def count(batches):
        from collections import Counter

        for b in batches:
            n = Counter()
            for lang, text in zip(b[0].to_pylist(), b[1].to_pylist()):
                for token, k in Counter(text.split()).items():
                    for w in letter_runs(token.lower()):
                        n[lang, _MARK + w] += k
            if n:
                yield pa.record_batch([pa.array([k[0] for k in n]), pa.array([k[1] for k in n]), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])

    words, words_path = materialize(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    column = {x: i for i, x in enumerate(langs)}
    prob = np.full((len(vocab) + 1, len(langs)), 1.0 / len(vocab))
    prob[-1] = _UNKNOWN
    for _ in range(rounds):

        def expect(batches, prob=prob):
            table, sums = lookup(path), np.zeros(prob.shape)
            for b in batches:
                lang = np.array([column[x] for x in b[0].to_pylist()], np.int64)
                sums += expected_uses(b[1].to_pylist(), lang, b[2].to_numpy(), table, prob)
            sums[-1] = 0
            at = np.nonzero(sums)
            yield pa.record_batch([pa.array(at[0], pa.int64()), pa.array(at[1], pa.int64()), pa.array(sums[at], pa.float64())], names=["piece", "lang", "uses"])

        got = words.mapInArrow(expect, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full((len(vocab), len(langs)), SMOOTHING)
        uses[got["piece"].to_numpy(int), got["lang"].to_numpy(int)] += got["uses"].to_numpy()
        prob = np.vstack([uses / uses.sum(axis=0), np.full((1, len(langs)), _UNKNOWN)])
    release(spark, words_path)
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    return langs, prob, prior


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """docs with lang_pred and score added: the language of greatest posterior over the whole text
    and that posterior tempered by the number of words' root. `und` and 0 where the text is null or
    has no letter, or nothing was learned. Ties go to the first language by name."""
    langs, prob, prior = model
    vocab_size = len(pieces(path))
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches):
        assert len(pieces(path)) == vocab_size, "the executors' vocabulary file is another one"
        table = lookup(path)
        number: dict[str, int] = {}
        known, sizes = np.zeros((0, len(langs))), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, text_col):
                tokens = [t.split() if t and langs else [] for t in part[text_col].to_pylist()]
                new = list({w for t in tokens for w in t}.difference(number))
                if len(number) + len(new) > MEMO:
                    number, known, sizes = {}, known[:0], sizes[:0]
                    new = list({w for t in tokens for w in t})
                if new:
                    number.update(zip(new, range(len(number), len(number) + len(new))))
                    words = [letter_runs(w.lower()) for w in new]
                    flat = [_MARK + w for ws in words for w in ws]
                    owner = np.repeat(np.arange(len(new)), [len(ws) for ws in words])
                    scores = score_parts(flat, table, prob) if flat else np.zeros((0, len(langs)))
                    known = np.vstack([known, np.column_stack([np.bincount(owner, weights=scores[:, c], minlength=len(new)) for c in range(len(langs))])])
                    sizes = np.concatenate([sizes, [len(ws) for ws in words]])
                preds, scores = [], []
                for t in tokens:
                    at = np.fromiter(map(number.__getitem__, t), np.int64, len(t))
                    n = int(sizes[at].sum())
                    if not n:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    total = prior + known[at].sum(axis=0)
                    best = int(np.argmax(total))
                    preds.append(langs[best])
                    scores.append(float(1.0 / np.exp((total - total[best]) / np.sqrt(n)).sum()))
                cols = [part[f.name] for f in kept if f.name != text_col] + [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
                yield pa.record_batch(cols, names=[*(f.name for f in kept if f.name != text_col), "lang_pred", "score"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name != text_col), "lang_pred string", "score double"])
    return spread(docs.select(*(f"`{f.name}`" for f in kept))).mapInArrow(run, ddl)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY) -> DataFrame:
    """id, held_out, lang_pred, score of every row; rows whose crc32(id) mod 3 is 1 teach nothing.

    A null id is not held out. Null languages teach nothing. Repeated rows stay. With no labelled
    row at all, every prediction is `und`. Extra columns are left out.
    """
    split = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    model = train(split.where(~F.col("held_out")), text_col, "lang", path)
    return predict(split.drop("lang"), model, text_col, path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
