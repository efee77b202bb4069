"""Graphs and components that one task holds: communities by all rounds in memory, components of a stretch of edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Edges whose components are found at once, and edges from which small components are no longer put together.
STRETCH, TOGETHER = 1_000_000, 200_000
#: Instead of a turn: the nodes of a level, the communities after it.
NODES, LEFT = -1, -2


def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """nodes (ascending), the edges by the places of their ends in it, each once, and the places of all of a, then b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one = np.sort(at[: len(a)] * len(nodes) + at[len(a) :])
    one = one[_starts(one)]
    return nodes, (one // len(nodes)).astype(np.int32), (one % len(nodes)).astype(np.int32), at


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of the nodes 0 to n - 1."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != (up := root[root])).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def rooted(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of a, b to a, b, root: edges, each once in a stretch, and nodes (b is null), with the root of their component in the stretch."""

    def made(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes, a, b, _ = numbered(*(np.concatenate(x) for x in zip(*held, strict=True)))
        root = nodes[roots(len(nodes), a, b)]
        ends = pa.concat_arrays([pa.array(nodes[b], kind), pa.nulls(len(nodes), kind)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes[a], nodes]), kind), ends, pa.array(np.concatenate([root[a], root]), kind)], names=["a", "b", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for x in batches:
            if x.num_rows:
                held.append((_of(x, "a"), _of(x, "b")))
            if sum(len(y) for y, _ in held) >= STRETCH:
                yield made(held)
                held = []
        if held:
            yield made(held)

    return run


def settled(kind: pa.DataType, m2: float | None, turns: list[int], still: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of component, a, b, on_a, on_b (bits: the turns of the ends), by component, to node, community, level, turn, n.

    Rows of nodes have no level; the others count the nodes that moved in a turn, and ``NODES`` and ``LEFT`` of a level.
    ``turns``: the rounds of each level.  Without ``m2`` the whole graph comes, so that rounds and levels may end by its own counts.
    """

    def rows(node: pa.Array, community: pa.Array, counts: np.ndarray, n: int) -> pa.RecordBatch:
        told = [pa.array(counts[:, k], t) if len(counts) else pa.nulls(n, t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([node, community, *told], names=["node", "community", "level", "turn", "n"])

    def made(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        nodes, community, counts = communities(*(whole.pop(0) for _ in range(4)), m2, turns, still)
        yield rows(pa.array(nodes, kind), pa.array(community, kind), np.zeros((0, 3), int), len(nodes))
        yield rows(pa.nulls(len(counts), kind), pa.nulls(len(counts), kind), np.array(counts), len(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, last = 0, None
        for x in batches:
            if not x.num_rows:
                continue
            component, now = _of(x, "component"), tuple(_of(x, k) for k in ("a", "b", "on_a", "on_b"))
            begin = 0
            for end in [*(np.flatnonzero(component[1:] != component[:-1]) + 1), len(component)]:
                if m2 is not None and size >= TOGETHER and component[begin] != last:
                    yield from made(held)
                    size = 0
                held.append(tuple(y[begin:end] for y in now))
                size, last, begin = size + end - begin, component[begin], end
        if held:
            yield from made(held)

    return run


def communities(a: np.ndarray, b: np.ndarray, on_a: np.ndarray, on_b: np.ndarray, m2: float | None, turns: list[int], still: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """nodes, community of each (its smallest node), counts (level, turn, n): the rounds and levels of ``graph.communities``."""
    nodes, x, y, at = numbered(a, b)
    on = np.zeros(len(nodes), on_a.dtype)
    on[at] = np.concatenate([on_a, on_b])
    del a, b, on_a, on_b, at
    whole, m2 = m2 is None, 2.0 * len(x) if m2 is None else m2
    w, k = np.ones(len(x)), np.bincount(np.concatenate([x, y]), minlength=len(nodes)).astype(float)
    of = np.arange(len(nodes))
    counts = []
    for level, rounds in enumerate(turns):
        n, idle = len(k), 0
        c = np.arange(n, dtype=np.int32)
        u, v, both = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([w, w])
        for turn in range(rounds):
            moved = _moved(u, v, both, k, c, on >> turn & 1 == 1, m2)
            counts.append((level, turn, moved))
            idle = idle + 1 if moved <= still * n else 0
            if whole and idle == 2:
                break
        del u, v, both
        names, to = np.unique(c, return_inverse=True)
        counts += [(level, NODES, n), (level, LEFT, len(names))]
        of = to[of]
        if whole and len(names) > (1 - still) * n:
            break
        # the weight of loops is in k only
        on, k = on[names], np.bincount(to, k)
        x, y = np.minimum(to[x], to[y]), np.maximum(to[x], to[y])
        apart = x != y
        pairs, at = np.unique(x[apart] * len(names) + y[apart], return_inverse=True)
        x, y, w = (pairs // len(names)).astype(np.int32), (pairs % len(names)).astype(np.int32), np.bincount(at, w[apart], len(pairs))
    _, first, to = np.unique(of, return_index=True, return_inverse=True)
    return nodes, nodes[first[to]], counts


def _moved(u: np.ndarray, v: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, on: np.ndarray, m2: float) -> int:
    """Moves the nodes that are on to their best communities, in ``c``; how many moved.  u, v, w: both directions, no loops."""
    n = len(k)
    kc = np.bincount(c, k, n)
    turn = on[u]
    key = u[turn].astype(np.int64) * n + c[v[turn]]
    if not len(key):
        return 0
    o = np.argsort(key)
    key = key[o]
    start = _starts(key)
    node, to, told = key[start] // n, key[start] % n, np.add.reduceat(w[turn][o], start)
    here = to == c[node]
    # its own community may hold no neighbour
    own = np.zeros(n)
    own[node[here]] = told[here]
    stay = own - k * (kc[c] - k) / m2
    gain = told - k[node] * (kc[to] - np.where(here, k[node], 0.0)) / m2
    start = _starts(node)
    most = np.maximum.reduceat(gain, start)
    best = np.flatnonzero(gain == np.repeat(most, np.diff(start, append=len(node))))
    best = best[_starts(node[best])]  # of equal gains the smallest community, but its own before all
    best = best[gain[best] > stay[node[best]]]
    c[node[best]] = to[best]
    return len(best)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _of(x: pa.RecordBatch, name: str) -> np.ndarray:
    return x.column(name).to_numpy(zero_copy_only=False)
