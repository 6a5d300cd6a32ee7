"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text, lower=True):
    return WORD.findall(((text or "").translate(LOWER)) if lower else (text or ""))


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def groups(rows):
    """Least id of each id's group, by comparing all pairs."""
    sets = [(i, frozenset(shingles(t))) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def leaks(docs, items):
    out = {}
    for d, text in docs:
        w = words(text)
        for item, t in items:
            n = min(len(words(t)), len(w))
            goal = Counter(shingles(t))
            best = (0.0, None)
            for s in range(len(w) - n + 1) if n else ():
                part = w[s : s + n]
                have = Counter(tuple(part[i : i + 5]) for i in range(max(1, n - 4)))
                least = sum((have & goal).values())
                value = least / (sum(have.values()) + sum(goal.values()) - least)
                if value > best[0]:
                    best = (value, s)
            if best[0] >= 0.75:
                out[d, item] = best
    return out


def dedup(rows):
    """rows: (id, text) in order of ids; the cleaned texts."""
    seen, out = set(), []
    for _, text in rows:
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if WORD.search(x)]
        covered = set()
        for p in range(len(full) - 2):
            key = tuple(lines[i] for i in full[p : p + 3])
            if key in seen:
                covered |= {p, p + 1, p + 2}
            seen.add(key)
        gone = {full[p] for p in covered}
        for a in sorted(covered):
            if a + 1 in covered:
                gone |= set(range(full[a], full[a + 1]))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if covered else text)
    return out
