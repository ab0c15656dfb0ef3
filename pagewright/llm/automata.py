"""Count transducers: weighted acyclic automata over paths of strings, as arrays by depth.

Level d holds the arcs of depth d, sorted by (state they leave, label). The arc in place
k leads to state k of that depth, so the arcs of the next level name their parent by
place. An arc's weight is how often its path was met; what isn't a whole path of the
input, but only the beginning of some, has the weight that was given for it, or 0. Labels
are numbers of a sorted vocabulary, so that arcs are in the order of the strings.

Sorted input makes a level by one pass over its (state, label) codes; a union puts the
levels of several transducers together and adds the weights of equal arcs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different strings in the order of their bytes, and each string's number."""
    strings = strings.cast(pa.binary())
    coded = strings.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def grouped(code: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different codes in order, each one's sum of weights (or number), and each element's place among them."""
    if not len(code):
        return code, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    fresh = np.append(True, sorted_[1:] != sorted_[:-1])
    edges = np.flatnonzero(fresh)
    back = np.empty(len(code), np.int64)
    back[order] = np.cumsum(fresh) - 1
    total = np.diff(np.append(edges, len(code))) if weight is None else np.add.reduceat(weight[order], edges)
    return sorted_[edges], total, back


@dataclass
class Transducer:
    vocabulary: pa.Array  # binary, sorted
    parent: list[np.ndarray] = field(default_factory=list)
    label: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)

    def __len__(self) -> int:
        return sum(map(len, self.weight))

    def grow(self, parent: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """Adds a level of arcs; returns the state that each given arc leads to."""
        size = max(len(self.vocabulary), 1)
        code, total, state = grouped(parent * size + label, weight)
        self.parent.append(code // size)
        self.label.append(code % size)
        self.weight.append(total)
        return state

    def paths(self, depth: int, first: int = 0, between: bytes = b" ") -> pa.Array:
        """The labels from level ``first`` to each state of ``depth``, joined; binary."""
        out = self.vocabulary.take(pa.array(self.label[depth]))
        at = self.parent[depth]
        for d in range(depth - 1, first - 1, -1):
            out = pc.binary_join_element_wise(self.vocabulary.take(pa.array(self.label[d][at])), out, between)
            at = self.parent[d][at]
        return out

    def ancestors(self, depth: int, level: int) -> np.ndarray:
        """The state of ``level`` that each state of ``depth`` lies under."""
        at = np.arange(len(self.label[depth]))
        for d in range(depth, level, -1):
            at = self.parent[d][at]
        return at

    def at_least(self, least: int) -> Transducer:
        """Without the arcs of less weight, and without what lies under them. An arc of weight 0, the way to paths that are counted, stays."""
        out = Transducer(self.vocabulary)
        place = None
        for parent, label, weight in zip(self.parent, self.label, self.weight):
            parent = parent if place is None else place[parent]
            keep = (parent >= 0) & ((weight >= least) | (weight == 0))
            place = np.where(keep, np.cumsum(keep) - 1, -1)
            out.parent.append(parent[keep])
            out.label.append(label[keep])
            out.weight.append(weight[keep])
        return out

    def weights_of(self, acceptor: Transducer) -> list[np.ndarray]:
        """Composition with an acceptor: the weight that each of its states' paths has here, 0 for a path that isn't here."""
        back = pc.index_in(acceptor.vocabulary, value_set=self.vocabulary)
        known = pc.fill_null(back, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(len(self.vocabulary), 1)
        out, state = [], np.zeros(1, np.int64)
        for d, (parent, label) in enumerate(zip(acceptor.parent, acceptor.label)):
            if d >= len(self.label) or not len(self.label[d]):
                out += [np.zeros(len(x), np.int64) for x in acceptor.label[d:]]
                break
            mine = self.parent[d] * size + self.label[d]
            above, label = state[parent], known[label]
            code = above * size + label
            at = np.minimum(np.searchsorted(mine, code), len(mine) - 1)
            found = (above >= 0) & (label >= 0) & (mine[at] == code)
            state = np.where(found, at, -1)
            out.append(np.where(found, self.weight[d][at], 0))
        return out


def union(parts: Sequence[Transducer]) -> Transducer:
    """One transducer with the summed weights of all."""
    if len(parts) == 1:
        return parts[0]
    vocabulary, number = numbered(pa.concat_arrays([p.vocabulary for p in parts]))
    at = np.cumsum([0, *(len(p.vocabulary) for p in parts)])
    names = [number[a:b] for a, b in zip(at, at[1:])]
    out, states = Transducer(vocabulary), [np.zeros(1, np.int64)] * len(parts)
    for d in range(max(len(p.label) for p in parts)):
        have = [i for i, p in enumerate(parts) if d < len(p.label)]
        parent = np.concatenate([states[i][parts[i].parent[d]] for i in have])
        label = np.concatenate([names[i][parts[i].label[d]] for i in have])
        state = out.grow(parent, label, np.concatenate([parts[i].weight[d] for i in have]))
        ends = np.cumsum([0, *(len(parts[i].label[d]) for i in have)])
        for i, a, b in zip(have, ends, ends[1:]):
            states[i] = state[a:b]
    return out
