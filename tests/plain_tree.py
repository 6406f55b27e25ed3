"""The condensed tree of a spanning tree and its clusters, in plain Python: what the distributed version is held against."""

from collections import defaultdict

import numpy as np


def condensed(a: list, b: list, w: np.ndarray, size: int, single: bool = False, epsilon: float = 0.0) -> dict:
    """Tree edges -> id: (label, strength) of the clusters with the most excess of mass that hold `size` ids at least."""
    names = sorted(set(a) | set(b))
    at = {x: i for i, x in enumerate(names)}
    n = len(names)
    up, top, count, kids, height = list(range(n)), list(range(n)), [1] * n, {}, {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k in sorted(range(len(w)), key=lambda k: (w[k], a[k], b[k])):
        x, y = find(at[a[k]]), find(at[b[k]])
        node = len(count)
        kids[node], height[node] = (top[x], top[y]), float(w[k])
        count.append(count[top[x]] + count[top[y]])
        up[y], top[x] = x, node
    root = len(count) - 1
    # clusters: id -> parent, birth; leaves: point -> cluster, density at which it leaves
    parent, birth, left, split, member, number = {0: -1}, {0: 0.0}, {}, {}, defaultdict(int), 1
    todo = [(root, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            left[node] = (c, 1e12)
            continue
        lam = 1 / max(height[node], 1e-12)
        big = [k for k in kids[node] if count[k] >= size]
        if len(big) == 2:
            split[c] = lam
            for k in kids[node]:
                parent[number], birth[number] = c, lam
                member[c] += count[k]
                todo.append((k, number))
                number += 1
            continue
        for k in kids[node]:
            if k in big:
                todo.append((k, c))
            else:  # all of a small part leave together
                member[c] += count[k]
                rest = [k]
                while rest:
                    x = rest.pop()
                    if x < n:
                        left[x] = (c, lam)
                    else:
                        rest += kids[x]
    mass = dict.fromkeys(parent, 0.0)
    for c, lam in left.values():
        mass[c] += lam - birth[c]
    sizes = defaultdict(int)
    for c, _ in left.values():
        sizes[c] += 1
    below = defaultdict(list)
    for c in sorted(parent, reverse=True):
        sizes[c] += sum(sizes[k] for k in below[c])
        if parent[c] >= 0:
            below[parent[c]].append(c)
    for c, kids_ in below.items():
        mass[c] += sum(sizes[k] * (birth[k] - birth[c]) for k in kids_)
    chosen: dict[int, bool] = {}
    for c in sorted(parent, reverse=True):
        inner = sum(mass[k] for k in below[c])
        root_barred = c == 0 and not single
        chosen[c] = not root_barred and (not below[c] or mass[c] >= inner)
        if not chosen[c]:
            mass[c] = inner
    owner: dict[int, int] = {}
    for c in sorted(parent):
        over = owner.get(parent[c], -1) if parent[c] >= 0 else -1
        owner[c] = over if over >= 0 else c if chosen[c] else -1
    if epsilon > 0:  # a chosen cluster born at a distance below epsilon becomes its first ancestor born above it
        rise = {}
        for c in {o for o in owner.values() if o >= 0}:
            x = c
            while parent[x] > 0 and birth[x] > 1 / epsilon:
                x = parent[x]
            rise[c] = x
        for c in sorted(parent):
            x, hit = c, -1
            while x >= 0:
                hit = x if x in rise.values() else hit
                x = parent[x]
            owner[c] = hit
    labels = {c: k for k, c in enumerate(sorted({o for o in owner.values() if o >= 0}))}
    peak = defaultdict(float)
    for c, lam in left.values():
        peak[c] = max(peak[c], lam)
    for c, lam in split.items():
        peak[c] = max(peak[c], lam)
    out = {}
    for x, (c, lam) in left.items():
        o = owner[c]
        p = 0.0 if o < 0 else 1.0 if not 0 < peak[o] < np.inf else min(lam, peak[o]) / peak[o]
        out[names[x]] = (labels.get(o, -1), p)
    return out
