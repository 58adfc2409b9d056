"""Plain Python versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


class Groups:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def near_groups(docs, k, percent=80):
    """{doc_id: (size of its set, component)} of (doc_id, text) pairs."""
    sets = {}
    for i, text in docs:
        w = words((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for i, s in sets.items():
        for shingle in s:
            holders[shingle].append(i)
    common = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    groups = Groups(sets)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def without_repeats(docs, window=35):
    """[(doc_id, words, removed, kept text)], one per row."""
    split = [words(t) for _, t in docs]
    seen = Counter(tuple(w[j : j + window]) for w in split for j in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def smith_waterman(passage, item, common=(), match=2, mismatch=-1, gap=-1):
    best, above = 0, [0] * (len(passage) + 1)
    for x in item:
        row = [0]
        for j, y in enumerate(passage):
            row.append(max(0, above[j] + ((match // 2 if x in common else match) if x == y else mismatch), above[j + 1] + gap, row[j] + gap))
        best, above = max(best, *row), row
    return best
