"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else (frozenset([tuple(w)]) if w else frozenset())


def contamination(texts, items, n=13):
    """(n_words, hit words, sorted ids) of each text; items: (id, text)."""
    windows = defaultdict(set)
    for ident, text in items:
        w = words(text)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[p:p + k])].add("" if ident is None else str(ident))
    sizes = {len(g) for g in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p:p + k])) in windows:
                    hit |= set(range(p, p + k))
                    found |= windows[g]
        out.append((len(w), len(hit), sorted(found)))
    return out


def near_classes(rows, threshold=0.8):
    """rows of (id, text) -> per row (smallest id of the class, links)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (ident, _) in enumerate(rows):
        least[find(i)].append(ident)
    return [(min((x for x in least[find(i)] if x is not None), default=None), links[i]) for i in range(len(rows))]


def dedup_lines(rows, min_words=50):
    """rows of (id, text), all different -> removed line numbers per row, by direct comparison of every run."""
    seqs = []
    for ident, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [(k, v, len(re.findall(r"[^\x20\x09-\x0D]+", v))) for k, v in enumerate(text.split("\n"))] if text is not None else []
        seqs.append((ident, text, [x for x in lines if x[2]]))
    seen, gone = {}, defaultdict(set)
    starts = [(s, p) for s in range(len(seqs)) for p in range(len(seqs[s][2]))]
    longest = {}
    for s, p in starts:                                   # longest earlier match of every suffix
        best = 0
        for s2, p2 in seen.get(seqs[s][2][p][1], []):
            n = 0
            while p + n < len(seqs[s][2]) and p2 + n < len(seqs[s2][2]) and seqs[s][2][p + n][1] == seqs[s2][2][p2 + n][1]:
                n += 1
            best = max(best, n)
        longest[s, p] = best
        seen.setdefault(seqs[s][2][p][1], []).append((s, p))
    for (s, p), n in longest.items():
        run = seqs[s][2][p:p + n]
        if sum(x[2] for x in run) >= min_words:
            gone[s] |= {x[0] for x in run}
    return {(seqs[s][0], seqs[s][1]): sorted(gone[s]) for s in range(len(seqs))}
