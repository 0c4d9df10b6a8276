"""Plain versions of what several tests need, one text at a time."""

import collections
import math
import re

import numpy as np
from graphnom.llm import quality as Q
from graphnom.llm import textkit as K

MASK = (1 << 64) - 1
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def buckets(text):
    """Buckets of a text's word unigrams and bigrams."""
    own = [mixed(sum((b + 1) * pow(K.BASE, i, 1 << 64) for i, b in enumerate(w.encode())) & MASK) for w in words(text)]
    pairs = [mixed((a * K.BASE + b * pow(K.BASE, 3, 1 << 64)) & MASK) for a, b in zip(own, own[1:])]
    return [x >> 48 for x in [*(mixed((w + 1) & MASK) for w in own), *pairs]]


def base_failed(text):
    w = words(text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def quality_verdicts(rows, good, bad):
    """Whether each (doc_id, text) is kept."""
    grams = [collections.Counter(buckets(t)) for _, t in rows]
    raw, target = collections.Counter(), collections.Counter()
    for (k, _), g in zip(rows, grams):
        raw.update(g)
        if k in set(good):
            target.update(g)
    n_raw, n_target = raw.total() + Q.SMOOTHING * Q.BUCKETS, target.total()
    scores = []
    for (k, _), g in zip(rows, grams):
        n, own = g.total(), k in set(good)
        total = n_target - n * own
        share = total / (total + 2 * Q.BUCKETS)
        scores.append(round(sum(c * math.log(share * ((target[b] - c * own) / total) / ((raw[b] + Q.SMOOTHING - c) / (n_raw - n)) + 1 - share) for b, c in g.items()) / max(n, 1), 9))
    sides = [np.array([s for (k, t), s in zip(rows, scores) if k in set(ids) and not base_failed(t)]) for ids in (good, bad)]
    limit = Q.parting(*sides)
    return [not base_failed(t) and s >= limit for (_, t), s in zip(rows, scores)]


def shingles(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    if not a.keys() & b.keys():
        return 0.0
    if len(a) == a.total() and len(b) == b.total():
        return len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def base_spans(text):
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def all_spans(text):
    """Base spans, and tokens that overlap none of them: (start, kind, end, value)."""
    base = base_spans(text)
    tokens = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]+", text) if len(m[0]) >= 28 and all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    return sorted(base + [t for t in tokens if not any(b[0] < t[2] and t[0] < b[2] for b in base)])


def targets(total):
    """Each source's target: 150 % of all words, dealt 3, 1, 2 by code point, never above twice the source."""
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        share = (1.5 * sum(total.values()) - sum(fixed.values())) / max(sum(weight[s] for s in free), 1e-9)
        over = [s for s in free if share * weight[s] > 2 * total[s]]
        if not over:
            return {s: fixed.get(s, share * weight[s]) for s in order}
        fixed |= {s: 2 * total[s] for s in over}
