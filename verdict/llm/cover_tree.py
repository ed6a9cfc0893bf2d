"""Cover trees of unit vectors and their dual traversal, on numpy arrays of one task.

A node covers a stretch of the points; its first point is its centre and its radius the largest distance to that, measured.
The children's centres are a net: no two are nearer than the largest power of two below the node's radius, and each point
belongs to a centre within that. So radii halve at least from level to level, and a node's centre is its first child's too.

A pair of nodes, of one tree or of two, is settled by the bounds: if the centres are further apart than both radii and the
threshold, no points of theirs are linked; if they and both radii fit into the threshold, all are, which is counted by the
nodes' weights at once. Else the children meet. Points of single-point children, and pairs of nodes of which the
bounds would leave more than a comparison costs, are compared by one product of matrices. All ways are exact.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Nodes of up to this many points have no children.
LEAF = 24
#: What the distance of two unit vectors may be off by in double precision, and more.
SLACK = 1e-7
#: Seconds for meeting one pair of nodes, and for comparing one pair of points: how the two ways are weighed, not a bound.
MEETING, COMPARING = 2e-5, 2e-8
ROWS = 512


class Tree(NamedTuple):
    points: np.ndarray  # (n, d), unit vectors in the order of the nodes
    order: np.ndarray  # the points' places in the input
    start: np.ndarray  # per node: its first point, which is its centre
    stop: np.ndarray
    first: np.ndarray  # per node: its first child
    last: np.ndarray  # and the node behind its last
    radius: np.ndarray


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the number of its centre's group, counted in the order of the centres; each first of a group is its
    centre, and no two centres are within ``radius``."""
    group, alive, found, least = np.zeros(len(points), np.int64), np.arange(len(points)), 0, 1 - radius * radius / 2
    while len(alive):
        rest = points[alive]
        near = rest[:256] @ rest.T >= least
        near[np.arange(len(near)), np.arange(len(near))] = True
        free = np.ones(len(alive), bool)
        for k in range(len(near)):
            if free[k]:
                own = near[k] & free
                group[alive[own]] = found
                free &= ~own
                found += 1
        alive = alive[free]
    return group


def build(points: np.ndarray) -> Tree:
    order = np.arange(len(points))
    start, stop, first, last, radius = [0], [len(points)], [], [], []
    k = 0
    while k < len(start):
        own = order[start[k] : stop[k]]
        far = float(distance(points[own] @ points[own[0]]).max()) if len(own) > 1 else 0.0
        radius.append(far)
        first.append(len(start))
        if len(own) > LEAF and far > 4 * SLACK:
            group = net(points[own], 2.0 ** (np.ceil(np.log2(far)) - 1))
            sizes = np.bincount(group)
            # The centre's own group first, then by size, so that single points stand together at the end.
            place = np.empty(len(sizes), np.int64)
            place[np.concatenate([[0], 1 + np.argsort(-sizes[1:], kind="stable")])] = np.arange(len(sizes))
            order[start[k] : stop[k]] = own[np.argsort(place[group], kind="stable")]
            ends = start[k] + np.cumsum(np.bincount(place[group]))
            start.extend([start[k], *ends[:-1].tolist()])
            stop.extend(ends.tolist())
        last.append(len(start))
        k += 1
    whole = lambda x: np.array(x, np.int64)
    return Tree(points[order], order, whole(start), whole(stop), whole(first), whole(last), np.array(radius))


class Links:
    """What a traversal finds: per point the weight of all points linked to it, and labels of connected points.

    The points are those of the trees, one tree after the other; ``labels`` may come from traversals before."""

    def __init__(self, weights: np.ndarray, labels: np.ndarray | None = None) -> None:
        self.weights, n = weights, len(weights)
        self.before = np.concatenate([[0], np.cumsum(weights)])
        self.counts, self.steps = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
        self.labels = np.arange(n) if labels is None else labels.copy()

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            x, y = self.labels[u], self.labels[v]
            apart = x != y
            if not apart.any():
                return
            u, v, x, y = u[apart], v[apart], x[apart], y[apart]
            np.minimum.at(self.labels, np.maximum(x, y), np.minimum(x, y))
            while (self.labels[self.labels] != self.labels).any():
                self.labels = self.labels[self.labels]

    def pairs(self, u: np.ndarray, v: np.ndarray, both: bool) -> None:
        """Points that are linked, each pair once if ``both``, else each way."""
        np.add.at(self.counts, u, self.weights[v])
        if both:
            np.add.at(self.counts, v, self.weights[u])
        self.join(u, v)

    def stretches(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """All points of two stretches are linked; a stretch with itself: each with all others."""
        sides = [(a, b)] if a == b else [(a, b), (b, a)]
        for own, other in sides:
            weight = self.before[other[1]] - self.before[other[0]]
            self.steps[own[0]] += weight
            self.steps[own[1]] -= weight
        if a == b:
            self.counts[a[0] : a[1]] -= self.weights[a[0] : a[1]]
        every = np.concatenate([np.arange(*a), np.arange(*b)])
        self.join(every, np.full(len(every), a[0]))

    def total(self) -> np.ndarray:
        return self.counts + np.cumsum(self.steps)[:-1]


def traverse(one: Tree, two: Tree | None, least: float, links: Links) -> None:
    """Finds all pairs of points of two trees, or of one if ``two`` is None, with a cosine of ``least`` or more."""
    other, shift = (one, 0) if two is None else (two, len(one.points))
    reach = float(np.sqrt(2 - 2 * least))

    def compare(a: tuple[int, int], b: tuple[int, int], same: bool) -> None:
        for at in range(a[0], a[1], ROWS):
            near = one.points[at : min(at + ROWS, a[1])] @ other.points[b[0] : b[1]].T >= least
            if same:
                rows = np.arange(len(near))
                near[rows, rows + at - b[0]] = False
            if near.any():
                u, v = np.nonzero(near)
                links.pairs(u + at, v + b[0] + shift, not same)

    def children(tree: Tree, k: int) -> np.ndarray:
        return np.arange(tree.first[k], tree.last[k]) if tree.last[k] > tree.first[k] else np.array([k])

    def meet(i: int, j: int) -> list[tuple[int, int]]:
        same = two is None and i == j
        a, b = (int(one.start[i]), int(one.stop[i])), (int(other.start[j]), int(other.stop[j]))
        moved = (b[0] + shift, b[1] + shift)
        if same and 2 * one.radius[i] < reach - SLACK:
            links.stretches(a, a)
            return []
        p, q = children(one, i), children(other, j)
        direct = (a[1] - a[0]) * (b[1] - b[0]) * COMPARING
        if len(p) == 1 and len(q) == 1 or direct < 5 * MEETING:
            compare(a, b, same)
            return []
        sizes = one.stop[p] - one.start[p], other.stop[q] - other.start[q]
        fat = [int(np.flatnonzero(s > 1).max(initial=0)) + 1 for s in sizes]

        def judged(x: slice, y: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            apart = distance(one.points[one.start[p[x]]] @ other.points[other.start[q[y]]].T)
            spread = one.radius[p[x]][:, None] + other.radius[q[y]]
            inside = apart + spread < reach - SLACK
            open_ = (apart - spread <= reach + SLACK) & ~inside
            if same:
                ordered = np.arange(len(p))[x][:, None] < np.arange(len(q))[y]
                inside, open_ = inside & ordered, open_ & ordered
            return *np.nonzero(inside), *np.nonzero(open_)

        # Fat children with all of the other side, single points of this side with fat ones of the other.
        corners = [(slice(0, fat[0]), slice(0, len(q)))] + [(slice(fat[0], len(p)), slice(0, fat[1]))] * (not same)
        met, included, cost = [], [], (len(p) - fat[0]) * (len(q) - fat[1]) * COMPARING
        for x, y in corners:
            for at in range(x.start, x.stop, ROWS):
                u, v, s, t = judged(slice(at, min(at + ROWS, x.stop)), y)
                included.append((p[u + at], q[v]))
                met.append((p[s + at], q[t]))
                cost += len(s) * MEETING + float((sizes[0][s + at] * sizes[1][t]).sum()) * COMPARING / 4
        if cost > direct:
            compare(a, b, same)
            return []
        for u, v in included:
            for x, y in zip(u.tolist(), v.tolist()):
                links.stretches((int(one.start[x]), int(one.stop[x])), (int(other.start[y]) + shift, int(other.stop[y]) + shift))
        if fat[0] < len(p) and fat[1] < len(q):
            compare((int(one.start[p[fat[0]]]), a[1]), (int(other.start[q[fat[1]]]), b[1]), same)
        own = [(int(k), int(k)) for k in p[: fat[0]]] if same else []
        return own + [pair for u, v in met for pair in zip(u.tolist(), v.tolist())]

    waiting = [(0, 0)]
    while waiting:
        waiting.extend(meet(*waiting.pop()))
