"""Plain Python versions of the corpus operators' contracts."""

import hashlib
from collections import Counter

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs):
    """doc_id -> (set size, smallest reachable doc_id) of [(doc_id, text)]."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in holders.get(s, ())).items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def without_repeats(docs, span=50):
    """doc_id -> (n_words, n_removed, kept words)."""
    first, out = {}, {}
    for i, t in sorted(docs):
        w, mine = words(t), []
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            key = tuple(w[s : s + span])
            if key in first:
                gone[s : s + span] = [True] * span
            else:
                mine.append(key)
        first.update((k, i) for k in mine)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))
    return out


def line_key(line):
    key = line.strip(BLANKS)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key) if len(key) >= 10 else None


def without_lines(docs):
    """doc_id -> (n_lines, n_dropped, text)."""
    first = {}
    for i, t in sorted(docs):
        for line in (t or "").split("\n"):
            first.setdefault(line_key(line), i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x) is None or first[line_key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def base_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered.update(range(i, i + 5))
    n, repeat = len(w), len(covered)
    return (n, sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n)
