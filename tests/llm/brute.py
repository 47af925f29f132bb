"""Plain single-machine versions of the operators, for comparison."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(docs, length=20):
    """docs: (doc_id, text), in any order -> {doc_id: (n_words, n_removed, sha)}; ids are distinct."""
    return {d: (n, g, hashlib.sha256(t.encode()).hexdigest()) for d, (n, g, t) in without_repeats(docs, length).items()}


def without_repeats(docs, length=20):
    """{doc_id: (n_words, n_removed, the words that stay, joined by one space)}."""
    seen, out = {}, {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[i : i + length] = [True] * length
            else:
                seen[key] = (doc, i)
        kept = [x for x, g in zip(w, gone) if not g]
        out[doc] = (len(w), sum(gone), " ".join(kept))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text, width=4):
    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=4):
    """fps: {doc: fingerprint} -> {doc: least doc reachable}."""
    docs = sorted(fps)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    f = np.array([fps[d] for d in docs], np.uint64)
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            a, b = find(docs[i]), find(docs[j])
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in docs}


def quality(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(grams)
    covered = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 8)}
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base


def mix_targets(size_of, weights=(3, 1, 2), share=1.5, most=2.0):
    """size_of: {source: words} -> {source: target}, by the loop of the definition."""
    names = sorted((s for s in size_of if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size_of else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, rest = {}, set(names), share * sum(size_of.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / total > most * size_of[s]}
        if not over:
            got |= {s: rest * w[s] / total for s in open_}
            break
        for s in over:
            got[s] = most * size_of[s]
        rest -= sum(got[s] for s in over)
        open_ -= over
    return got


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sources(rows):
    out = defaultdict(int)
    for source, text in rows:
        out[source] += len(words(text))
    return dict(out)


def slots(targets, block):
    """Sources of the slots of a mix, by exact golden-ratio points. targets: {source: target}, in rank order."""
    import math
    from fractions import Fraction

    total = sum(Fraction(t) for t in targets.values())
    edges, at = [], Fraction(0)
    for source, t in targets.items():
        at += Fraction(t) / total
        edges.append((at, source))
    step = Fraction(1640531527, 1 << 32)
    return [next(s for e, s in edges if (k * step) % 1 < e) for k in range(math.ceil(total / block))]


def near_copies(rows):
    """rows: (doc_id, text), ids distinct -> the least id of each component of all pairs of similarity 0.8 or more."""
    sets = {}
    for d, text in sorted(rows):
        w = words(lower(text))
        sets[d] = frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    by, root = {}, {d: d for d in sets}
    for d, s in sets.items():
        for g in s or [None]:
            by.setdefault(g, []).append(d)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for group in by.values() for k, b in enumerate(group) for a in group[:k]}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if 5 * len(x & y) >= 4 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted(d for d in sets if find(d) == d)
