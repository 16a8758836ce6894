"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import math
import zlib
from collections import Counter


def words(text, lower=True):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def shingles(text, n=5):
    ws = words(text)
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def groups(rows, percent=80, n=5):
    """{id: (n_shingles, smallest id reachable)} of rows (id, text)."""
    sets = [(d, shingles(t, n)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


def deduped(rows, n=35):
    """[(id, words, removed, digest)] of rows (id, text)."""
    ws = [words(t, lower=False) for _, t in rows]
    times = Counter(tuple(w[i : i + n]) for w in ws for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, ws, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if times[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def contained(docs, items, percent=80, n=5):
    sized = [(i, min(n, len(words(t))), t) for i, t in items]
    sets = {k: [(d, shingles(t, k)) for d, t in docs] for k in range(1, n + 1)}
    return sorted((d, i, len(q), len(q & s)) for i, q, k in ((i, shingles(t, k), k) for i, k, t in sized if k) for d, s in sets[k] if 100 * len(q & s) >= percent * len(q))


def base_scores(rows):
    """{id: (n_tokens, n_known, train_tokens, base_score)} of rows (id, text)."""
    tokens = {d: [*words(t), None] for d, t in rows}
    counts = Counter(x for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 10 for x in w)
    n, v = sum(counts.values()), len(counts)
    return {d: (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for d, w in tokens.items()}
