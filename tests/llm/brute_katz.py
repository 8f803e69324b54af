"""The Katz model spelled out with dictionaries."""

import math
import re
from collections import Counter, defaultdict

from sessionmill.llm.katz import K, good_turing

END, START = "</s>", "<s>"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [END]


def model(training):
    uni, pairs = Counter(), Counter()
    for t in map(tokens, training):
        uni.update(t)
        pairs.update(zip([START, *t], t))
    n = sum(uni.values())
    of = lambda c: [sum(1 for v in c.values() if v == r) for r in range(1, K + 2)]
    d1, d2 = good_turing(of(uni)), good_turing(of(pairs))
    left = sum((1 - d1[c]) * c for c in uni.values() if c <= K)
    if left > 0:
        p1 = {w: (d1[c] if c <= K else 1) * c / n for w, c in uni.items()}
        unknown = left / n
    else:
        p1 = {w: c / (n + 1) for w, c in uni.items()}
        unknown = 1 / (n + 1)
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c
    cond, alpha = {}, {}
    for h, seen in after.items():
        total = sum(seen.values())
        left = sum((1 - d2[c]) * c for c in seen.values() if c <= K)
        below, left = (total, left) if left > 0 else (total + 1, 1.0)
        cond[h] = {w: (d2[c] if c <= K else 1) * c / below for w, c in seen.items()}
        alpha[h] = left / below / (1 - sum(p1[w] for w in seen))
    return uni, n, p1, unknown, cond, alpha


def probability(m, h, w):
    uni, n, p1, unknown, cond, alpha = m
    low = p1.get(w, unknown)
    if h not in cond:
        return low
    return cond[h][w] if w in cond[h] else alpha[h] * low


def score(m, text):
    uni, n, p1, unknown, cond, alpha = m
    t = tokens(text)
    return (
        len(t), sum(w in uni for w in t),
        sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in t),
        sum(math.log10(probability(m, h, w)) for h, w in zip([START, *t], t)),
    )
