"""Near duplicates with sets and all pairs."""

import re


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def shingle_set(text, k=5):
    w = word_list(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_duplicates(rows):
    """rows: (doc_id, text) -> {(doc_id, n, component)} as a sorted list"""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 80 * (len(x) + len(y) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)
