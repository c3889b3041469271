"""Graphs as arrays of one task: strings coded by their order, links by node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Links, counted from both ends, that one task may hold, at some 25 bytes each and 80 bytes a node.
TASK_LINKS = 40_000_000


def links_of(start: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the links of some nodes, and how many each has."""
    size = start[nodes + 1] - start[nodes]
    ends = np.cumsum(size)
    return np.repeat(start[nodes] - ends + size, size) + np.arange(size.sum()), size


class _Codes:
    """Numbers of strings, by arrival."""

    def __init__(self):
        self.names = pa.array([], pa.large_string())

    def of(self, texts: list[pa.Array]) -> np.ndarray:
        found = pa.chunked_array(texts).cast(pa.large_string()).combine_chunks().dictionary_encode()
        new = found.dictionary.filter(pc.invert(pc.is_in(found.dictionary, value_set=self.names)))
        self.names = pa.concat_arrays([self.names, new])
        return pc.index_in(found.dictionary, value_set=self.names).to_numpy()[found.indices.to_numpy()]

    def ranks(self) -> tuple[pa.Array, np.ndarray]:
        """The strings in order, and the place of each number: the order of arrival must not matter."""
        order = pc.sort_indices(self.names)
        rank = np.empty(len(self.names), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(self.names))
        return self.names.take(order), rank


def coded(batches: Iterator[pa.RecordBatch], rows: int = 1_000_000) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray | None]:
    """(strings in order, a, b, w): the first two columns of all batches as places of their
    strings, and the third, if there is one."""
    codes, parts, held = _Codes(), [], []

    def take() -> None:
        both = codes.of([x.column(0) for x in held] + [x.column(1) for x in held]).reshape(2, -1)
        parts.append((*both, np.concatenate([x.column(2).to_numpy(zero_copy_only=False) for x in held]).astype(np.int64) if held[0].num_columns > 2 else None))
        held.clear()

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            take()
    if held:
        take()
    names, rank = codes.ranks()
    none = np.zeros(0, dtype=np.int64)
    a, b = (np.concatenate([none, *(rank[x[k]] for x in parts)]) for k in (0, 1))
    return names, a, b, np.concatenate([none, *(x[2] for x in parts)]) if parts and parts[0][2] is not None else None


def paired(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every pair from both ends once, in order."""
    key = np.concatenate([a * n + b, b * n + a])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
    return (key // n).astype(np.int32), (key % n).astype(np.int32)


def walked(start: np.ndarray, to: np.ndarray, sources: list[int]) -> np.ndarray:
    """For each node, how many shortest paths from the sources pass through it (Brandes), a source's
    own left out; level by level until nothing new is reached. Links hold no loops."""
    n = len(start) - 1
    score, seen, paths, flow = np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n)
    for source in sources:
        front = np.array([source])
        levels, reached = [], [front]
        seen[source], paths[source] = True, 1.0
        while True:
            links, size = links_of(start, front)
            other = to[links]
            new = ~seen[other]
            if not new.any():
                break
            here, other = np.repeat(front.astype(np.int32), size)[new], other[new]
            np.add.at(paths, other, paths[here])
            front = np.unique(other)
            seen[front] = True
            levels.append((here, other))
            reached.append(front)
        for here, other in reversed(levels):
            np.add.at(flow, here, paths[here] / paths[other] * (1 + flow[other]))
        flow[source] = 0.0
        every = np.concatenate(reached)
        score[every] += flow[every]
        seen[every], paths[every], flow[every] = False, 0.0, 0.0
    return score
