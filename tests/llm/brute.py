"""Plain versions of the operators, for small inputs."""

import collections
import re

from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def substring_dedup(rows, size=13):
    """(n_words, n_removed, kept) of each (doc_id, text)."""
    order = lambda d: (d is None, d or 0)
    words = [(d, spaced(t)) for d, t in rows]
    first = {}
    for d, w in sorted(words, key=lambda x: order(x[0])):
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if order(first[tuple(w[i : i + size])]) < order(d):
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text):
    w = spaced((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_components(rows):
    """doc_id: (size, least doc_id reached)."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= 80 * either:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def decontaminate(rows, items, size=10):
    """(n_words, n_hit, sorted items) of each (doc_id, text)."""
    patterns = collections.defaultdict(set)
    for item, text in items:
        w = plain(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[i : i + n])].add(str(item))
    out = []
    for _, text in rows:
        w, found = plain(text), set()
        hit = [False] * len(w)
        for p, names in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit[i : i + len(p)] = [True] * len(p)
                    found |= names
        out.append((len(w), sum(hit), sorted(found)))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = spaced(text)
    lines, seen, repeated = [x for x in text.split("\n") if spaced(x)], set(), 0
    for x in lines:
        repeated += x in seen
        seen.add(x)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, repeated, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def with_extra_columns(frame, names):
    """`frame` with a column of each name, whose cells tell the name and the row's id."""
    cells = [F.concat(F.lit(f"{n}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names]
    return frame.select("*", *cells)


def extra_cells(row, names):
    return (row["doc_id"], *(row[n] for n in names))
