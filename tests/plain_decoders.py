"""One document at a time, the plain way: what the decoders over tables are held against."""

import itertools
from functools import cache
from math import inf

import numpy as np

FAR = 1e6


class Doc:
    """Scores over units in reading order; links maps (p, c) to (pair_ix, attach, coordinating)."""

    def __init__(self, n, links, spans):
        self.n, self.links, self.spans = n, links, spans

    def score(self, p, c, odds):
        if (p, c) not in self.links:
            return -FAR * FAR
        w = self.links[p, c][1]
        if w <= 0 or odds and w >= 1:
            return FAR if w > 0 else -FAR
        return float(np.log(w / (1 - w)) if odds else np.log(w))

    def total(self, links, odds):
        return sum(self.score(p, c, odds) for p, c in links)


def all_trees(n):
    for rest in itertools.product(range(n), repeat=n - 1):
        parents, ok = [0, *rest], True
        for v in range(1, n):
            seen = set()
            while v and v not in seen:
                seen.add(v)
                v = parents[v]
            ok = ok and v == 0
        if ok:
            yield [(p, c) for c, p in enumerate(parents) if c]


def projective(tree):
    spans = [(min(x), max(x)) for x in tree]
    return not any(a < c < b < d for (a, b), (c, d) in itertools.permutations(spans, 2))


def best_tree(doc, fit=lambda tree: True, odds=True):
    return max(doc.total(t, odds) for t in all_trees(doc.n) if fit(t))


def best_projective(n, score):
    """The best total of a projective tree from unit 0 with one child; `score` has the links (p, c)."""
    @cache
    def opened(i, j, head):
        own = score.get((i, j) if head == i else (j, i), -inf)
        return own + max(closed(i, k, i) + closed(k + 1, j, j) for k in range(i, j))

    @cache
    def closed(i, j, head):
        if i == j:
            return 0.0
        if head == i:
            return max(opened(i, k, i) + closed(k, j, k) for k in range(i + 1, j + 1))
        return max(closed(i, k, k) + opened(k, j, j) for k in range(i, j))

    return max(score.get((0, c), -inf) + closed(1, c, c) + closed(c, n - 1, c) for c in range(1, n))


def dag(doc, tree):
    """The tree's links, then all others by falling score that close no circle."""
    reach = np.eye(doc.n, dtype=bool)

    def add(p, c):
        reach[np.ix_(reach[:, p], reach[c])] = True

    out = set(tree)
    for p, c in tree:
        add(p, c)
    for p, c in sorted(doc.links, key=lambda x: (-doc.score(*x, True), doc.links[x][0])):
        if c and (p, c) not in out and not reach[c, p]:
            add(p, c)
            out.add((p, c))
    return out


def near(doc):
    s, e = zip(*doc.spans, strict=True)
    out = [set() for _ in range(doc.n)]
    for a, b in itertools.permutations(range(doc.n), 2):
        nested = (s[b] <= s[a] and e[a] <= e[b]) or (s[a] <= s[b] and e[b] <= e[a])
        ends = [p for m in range(doc.n) if m not in (a, b) for p in (s[m], e[m])]
        if nested or not any(e[x] <= p <= s[y] for p in ends for x, y in ((a, b), (b, a))):
            out[a].add(b)
    return out


def greedy(doc):
    by, left, out = near(doc), set(range(doc.n)), set()
    while len(left) > 1:
        some = [(doc.links[p, c][1], -p, -c) for p in left for c in by[p] if (p, c) in doc.links and doc.links[p, c][1] > 0]
        if not some:
            break
        _, p, c = max(some)
        out.add((-p, -c))
        left.remove(-p)
        by[-c] = by[-c] | by[-p]
    return out


def reading_order(doc, frontier, nbest):
    """All ways to attach every unit to one that is still in reach; the costs of the cheapest."""
    states = [((0,), 0.0, ())]
    for c in range(1, doc.n):
        grown = []
        for reach, cost, path in states:
            for at, p in enumerate(reach):
                if (p, c) in doc.links:
                    ix, _, coord = doc.links[p, c]
                    keep = reach if frontier == "none" else reach[:at] if frontier == "full" and coord else reach[: at + 1]
                    grown.append(((*keep, c), cost - doc.score(p, c, False), (*path, ix)))
        states = grown
    return sorted(((cost, path) for _, cost, path in states if path))[:nbest]


def arborescence(score, root=0):
    """The parents of the best tree from `root` over a whole matrix of scores, contracting a circle at a time."""
    score = score.copy()
    np.fill_diagonal(score, -np.inf)
    score[:, root] = -np.inf
    parent = score.argmax(axis=0)
    parent[root] = root
    ring = None
    for v in range(len(score)):
        path = []
        while v != root and v not in path:
            path.append(v)
            v = parent[v]
        if v != root:
            ring = np.array(path[path.index(v) :])
            break
    if ring is None:
        return parent
    rest = [v for v in range(len(score)) if v not in set(ring.tolist())]
    m = len(rest)
    inner = np.full((m + 1, m + 1), -np.inf)
    inner[:m, :m] = score[np.ix_(rest, rest)]
    enter, leave = score[np.ix_(rest, ring)] - score[parent[ring], ring], score[np.ix_(ring, rest)]
    inner[:m, m], inner[m, :m] = enter.max(axis=1), leave.max(axis=0)
    found, out = arborescence(inner, rest.index(root)), parent.copy()
    for k, v in enumerate(rest):
        if v != root:
            out[v] = rest[found[k]] if found[k] < m else ring[leave[:, k].argmax()]
    out[ring[enter[found[m]].argmax()]] = rest[found[m]]
    return out
