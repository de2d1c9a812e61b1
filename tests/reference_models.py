"""Small single-process models that the distributed results are compared with."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np


def find(above: dict, x):
    while above.setdefault(x, x) != x:
        x = above[x]
    return x


def components(edges) -> dict:
    above: dict = {}
    for u, v in edges:
        a, b = sorted((find(above, u), find(above, v)))
        above[b] = a
    return {x: find(above, x) for x in list(above)}


def merge_events(rows) -> list:
    """``seq`` of the edges that join two components, for ``(seq, u, v)`` in any order."""
    above, found = {}, []
    for seq, u, v in sorted(rows):
        a, b = sorted((find(above, u), find(above, v)))
        if a != b:
            above[b] = a
            found.append(seq)
    return found


def _z(x, series):
    if not series:
        return 0.0
    ordered = sorted(series)
    m = ordered[len(ordered) // 2]
    spread = sorted(abs(v - m) for v in ordered)[len(ordered) // 2]
    return (x - m) / max(1.4826 * spread, 1e-9)


def merge_scores(rows) -> dict:
    """seq -> (root, edges, distinct, out_hh, density, three z values), for (seq, u, v, amount)."""
    above, size, count, past, flow, out = {}, {}, {}, {}, defaultdict(int), {}
    for seq, u, v, amount in sorted(rows):
        flow[u] += int(max(1.0, amount))
        a, b = sorted((find(above, u), find(above, v)))
        if a == b:
            count[a] = count.get(a, 0) + 1
            continue
        above[b] = a
        size[a] = size.get(a, 1) + size.pop(b, 1)
        count[a] = count.get(a, 0) + count.pop(b, 0) + 1
        history = sorted(past.pop(b, []) + past.get(a, []))[-256:]
        now = (float(size[a]), float(flow[u]), 2 * count[a] / (size[a] * (size[a] - 1)))
        z = [_z(now[i], [h[i + 1] for h in history]) for i in range(3)]
        past[a] = (history + [(seq, *now)])[-256:]
        out[seq] = (a, count[a], *now, *z)
    return out


def same_scores(got: dict, expected: dict) -> bool:
    return got.keys() == expected.keys() and all(
        np.allclose(np.array(got[k], float), np.array(expected[k], float), rtol=1e-9) for k in expected
    )


def centrality(edges) -> dict:
    """account -> (closeness, betweenness) on the undirected simple graph."""
    near = defaultdict(set)
    for u, v in edges:
        near[u], near[v]
        if u != v:
            near[u].add(v)
            near[v].add(u)
    between = dict.fromkeys(near, 0.0)
    close = {}
    for s in near:
        order, hops, paths, before = [], {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list)
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in hops:
                    hops[w] = hops[v] + 1
                    queue.append(w)
                if hops[w] == hops[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        total = sum(hops.values())
        close[s] = (len(hops) - 1) / total if total else 0.0
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                between[w] += share[w] / 2
    return {a: (close[a], between[a]) for a in near}
