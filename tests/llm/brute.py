"""Plain, slow versions of what the operators compute."""

import hashlib
from collections import Counter


def removed_bytes(rows, window):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + window] for _, b in raw for j in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if seen[b[j : j + window]] > 1:
                gone[j : j + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed_words(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        left, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            left, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, left + (x != y))
    return d[-1]


def kept_lines(rows, min_chars, fuzzy, k):
    """text of each row with repeated and near lines gone but for the first."""
    where = {}
    for i, t in sorted(set(rows)):
        for n, line in enumerate(t.split("\n")):
            if len(s := line.strip(" \t\n\x0b\x0c\r")) >= min_chars:
                where.setdefault(s, []).append((i, n))
    lines, parent = list(where), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, a in enumerate(lines):
        for b in lines[x + 1 :]:
            if min(len(a), len(b)) >= fuzzy and edit_distance(a, b) <= k:
                parent[root(a)] = root(b)
    first = {}
    for s in lines:
        first[root(s)] = min(first.get(root(s), (1 << 60, 0)), min(where[s]))
    out = {}
    for i, t in rows:
        keep = []
        for n, line in enumerate(t.split("\n")):
            s = line.strip(" \t\n\x0b\x0c\r")
            if len(s) < min_chars or first[root(s)] == (i, n):
                keep.append(line)
        out[i] = "\n".join(keep)
    return out


def simhash(text):
    import xxhash

    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(rows, bits):
    fps = [(i, simhash(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= bits:
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(fps):
        least[root(x)] = min(least.get(root(x), i), i)
    return [(i, f"{f:016x}", least[root(x)]) for x, (i, f) in enumerate(fps)]


def leaks(docs, items, module):
    """(doc, item) -> BM25 share of every passage against every item, verified on words."""
    import math

    texts = {i: module.terms_of(t) for i, t in items}
    mean = sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    idf = {w: math.log(1 + (len(texts) - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    out = {}
    for i, t in docs:
        words = module.terms_of(t)
        for j, item in items:
            n, stride = len(texts[j]), module.STRIDE
            while stride < n:
                stride *= 2
            longest = max(len(x) for x in texts.values() if len(x) <= stride and (stride == module.STRIDE or len(x) > stride // 2))
            stride = max(module.STRIDE, longest)
            norm = module.K1 * (1 - module.B + module.B * n / mean)
            impact = {w: idf[w] * k * (module.K1 + 1) / (k + norm) for w, k in Counter(texts[j]).items()}
            parts = module.question_and_answer(dict(items)[j])
            for at in range(0, len(words), stride):
                passage = words[at : at + 2 * stride]
                score = sum(x for w, x in impact.items() if w in set(passage)) / sum(impact.values())
                shares = []
                for p in parts:
                    k = min(module.SHINGLE, len(p))
                    grams = {tuple(p[a : a + k]) for a in range(len(p) - k + 1)} if k else set()
                    have = {tuple(passage[a : a + k]) for a in range(len(passage) - k + 1)}
                    shares.append(len(grams & have) / len(grams) if grams else 1.0)
                if score >= module.THETA - 1e-6 and min(shares) >= module.OVERLAP:
                    out[i, j] = max(score, out.get((i, j), 0))
    return out


def style_tree(pages, module):
    """path -> composite importance over the distinct pages of one host, by recursion."""
    import math

    seen = [module.features(module.parse(p)) for p in dict.fromkeys(pages)]
    styles, texts, parent = {}, {}, {}
    for i, found in enumerate(seen):
        for node, up, _, _, kind, feature in found:
            parent[node] = up
            if kind == 0:
                styles.setdefault(node, []).append(feature)
            else:
                texts.setdefault(node, {}).setdefault(feature, set()).add(i)
    kids = {}
    for node, up in parent.items():
        if node != up:
            kids.setdefault(up, []).append(node)

    def composite(node):
        m = len(styles[node])
        log = lambda x: math.log(x) / math.log(m) if m > 1 else 0.0
        style = -sum(k / m * log(k / m) for k in Counter(styles[node]).values()) if m > 1 else 1.0
        content = 1 - sum(log(len(p)) for p in texts[node].values()) / len(texts[node]) if node in texts else None
        if node not in kids:
            return 1.0 if content is None else content
        parts = [(len(styles[k]), composite(k)) for k in kids[node]] + ([(m, content)] if content is not None else [])
        decay = module.DECAY ** len(parts)
        return (1 - decay) * style + decay * sum(w * x for w, x in parts) / sum(w for w, _ in parts)

    return {node: composite(node) for node in styles}
