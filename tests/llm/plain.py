"""Plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import math
import re
from collections import Counter

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BLANKS.split(text or "") if w]


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    repeated = {p for i, x in enumerate(windows) if n[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    symbols = sum(c in "#*$%&|<>" for c in text)
    chars = sum(map(len, w))
    base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    upper = sum(c.isupper() for c in text)
    bad = (base or symbols > 0.3 * len(w) or upper > 0.3 * len(text) or dup > 0.4 * len(lines)
           or not 3 <= chars / max(len(w), 1) <= 12)
    return len(w), chars, symbols, dup, len(repeated), base, not bad


def shingles(text):
    w = words(lower_ascii(text))
    if not w:
        return frozenset()
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def components(docs, percent=85):
    """doc_id -> smallest linked doc_id, over (doc_id, text) rows."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in docs}


def without_repeated_lines(docs, least=50):
    """doc_id -> (text, lines, removed) for rows sorted by id."""
    lines = {i: t.split("\n") for i, t in docs if t is not None}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        for p in range(len(lines[i])):
            total = 0
            for q in range(p, len(lines[i])):
                total += len(words(lines[i][q]))
                if total >= least:
                    run = tuple(lines[i][p:q + 1])
                    if run in seen:
                        gone[i].update(range(p, q + 1))
                    seen.add(run)
                    break
    return {i: ("\n".join(x for p, x in enumerate(lines[i]) if p not in gone[i]), len(lines[i]), len(gone[i])) for i in lines}


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def holds(text, item, window=20, share=0.15):
    """Whether a text holds an item but for some substitutions."""
    a, b = tokens(text), tokens(item)
    if len(b) < 8:
        return False
    width = min(window, len(b))
    need = width - int(width * share)
    for d in range(-len(b) + 1, len(a)):
        same = [0 <= d + j < len(a) and a[d + j] == x for j, x in enumerate(b)]
        if any(sum(same[s:s + width]) >= need for s in range(len(b) - width + 1)):
            return True
    return False


def kneser_ney(trusted, texts, order, start):
    """log2 probability of each n-gram of ``texts`` under the model of ``trusted``."""
    grams = lambda t: [(start * (order - 1) + t)[i:i + order] for i in range(len(t))]
    everything = {g for t in [*trusted, *texts] for g in grams(t)}
    level = {order: Counter({g: 0 for g in everything})}
    for t in trusted:
        level[order].update(grams(t))
    for k in range(order - 1, 0, -1):
        level[k] = Counter({g[1:]: 0 for g in level[k + 1]})
        for g, n in level[k + 1].items():
            level[k][g[1:]] += n > 0

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0, 0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), float(k)) for k in (1, 2, 3)]

    p, total = {}, sum(level[1].values())
    d = discounts(level[1])
    taken = sum(d[min(v, 3)] for v in level[1].values())
    for g, v in level[1].items():
        even = 1 / (len(level[1]) + 1)
        p[g] = (v - d[min(v, 3)]) / total + taken / total * even if total else even
    for k in range(2, order + 1):
        d, sums, cut = discounts(level[k]), Counter(), Counter()
        for g, v in level[k].items():
            sums[g[:-1]] += v
            cut[g[:-1]] += d[min(v, 3)]
        p.update({g: (v - d[min(v, 3)]) / sums[g[:-1]] + cut[g[:-1]] / sums[g[:-1]] * p[g[1:]] if sums[g[:-1]] else p[g[1:]] for g, v in level[k].items()})
    return {g: math.log2(p[g]) for g in everything}
