"""Plain Python versions of operators that SQL can't express."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shingles(text, n):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near(rows, n, percent):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows."""
    sets = {i: shingles(t, n) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for i in ids:
        if not sets[i]:
            continue
        common = {}
        for s in sets[i]:
            for j in where[s]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, both in common.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(parent, i)) for i in ids}
