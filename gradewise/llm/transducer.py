"""Weighted acyclic automata over word sequences, as arrays.

States of one depth are numbered in the order of the sequences that lead to
them, so an automaton is one array of arc labels, one of the states the arcs
come from and one of final weights for each depth, and is built in one sweep
over sorted sequences: a sequence adds states from where it leaves the one
before it.  The total weight of what begins with the words that lead to a state
is its weight and the totals of the states after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

Words = tuple[bytes, ...]
NONE = -1  # a place behind a sequence's end


def summed(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in rising order and the summed weights of equal ones."""
    if not len(rows):
        return rows, weights
    order = np.lexsort(rows.T[::-1])
    rows, weights = rows[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(weights, first)


class Transducer:
    def __init__(self, labels: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.labels = labels  # sorted
        self.levels = levels  # per depth: label, state before, weight

    @classmethod
    def from_rows(cls, labels: list[bytes], rows: np.ndarray, weights: np.ndarray) -> Transducer:
        """From distinct sequences in rising order: rows of label numbers, ``NONE`` behind the end."""
        levels = []
        at = np.zeros(len(rows), np.int64)  # each row's state so far
        inside = np.ones(len(rows), bool)
        changed = np.zeros(len(rows), bool)  # since the row before
        for d in range(rows.shape[1]):
            inside = inside & (rows[:, d] != NONE)
            if not inside.any():
                break
            changed[1:] |= rows[1:, d] != rows[:-1, d]
            new = changed | np.concatenate([[True], ~inside[:-1]])
            new &= inside
            new[np.argmax(inside)] = True
            state = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            weight = np.zeros(len(first), np.int64)
            ends = inside & (rows[:, d + 1] == NONE) if d + 1 < rows.shape[1] else inside
            weight[state[ends]] = weights[ends]
            levels.append((rows[first, d].astype(np.int32), at[first].astype(np.int32), weight))
            at = state
        return cls(labels, levels)

    @classmethod
    def build(cls, items: Iterable[tuple[Words, int]]) -> Transducer:
        """From (sequence, weight) in rising order of the sequences."""
        items = list(items)
        if any(a[0] >= b[0] for a, b in zip(items, items[1:])):
            raise ValueError("sequences must rise")
        labels = sorted({w for words, _ in items for w in words})
        number = {w: i for i, w in enumerate(labels)}
        rows = np.full((len(items), max((len(w) for w, _ in items), default=0)), NONE, np.int64)
        for i, (words, _) in enumerate(items):
            rows[i, :len(words)] = [number[w] for w in words]
        return cls.from_rows(labels, rows, np.array([n for _, n in items], np.int64))

    def paths(self) -> Iterator[np.ndarray]:
        """Per depth the label numbers that lead to each of its states."""
        path = np.zeros((1, 0), np.int64)
        for label, before, _ in self.levels:
            path = np.concatenate([path[before], label[:, None]], axis=1)
            yield path

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of label numbers of the sequences that have a weight, and the weights."""
        depth, out, weights = len(self.levels), [np.zeros((0, len(self.levels)), np.int64)], [np.zeros(0, np.int64)]
        for d, (path, level) in enumerate(zip(self.paths(), self.levels)):
            ends = level[2] > 0
            out.append(np.pad(path[ends], ((0, 0), (0, depth - d - 1)), constant_values=NONE))
            weights.append(level[2][ends])
        return np.concatenate(out), np.concatenate(weights)

    def totals(self) -> list[np.ndarray]:
        """Per depth the total of the sequences that go through each state."""
        out: list[np.ndarray] = []
        for d in range(len(self.levels) - 1, -1, -1):
            total = self.levels[d][2].copy()
            if out:
                np.add.at(total, self.levels[d + 1][1], out[-1])
            out.append(total)
        return out[::-1]

    def phrases(self, states: list[np.ndarray]) -> Iterator[tuple[Words, int, int]]:
        """(words, depth, state) of the states marked at each depth."""
        for d, (path, marked) in enumerate(zip(self.paths(), states)):
            for s, row in zip(np.flatnonzero(marked).tolist(), path[marked].tolist()):
                yield tuple([self.labels[i] for i in row]), d, s

    def compose(self, asked: list[Words]) -> list[int | None]:
        """The weight of each sequence asked for (none: not there), all walked
        one depth at a time."""
        number = {w: i for i, w in enumerate(self.labels)}
        size = np.array([len(w) for w in asked], np.int64)
        at = np.zeros(len(asked), np.int64)
        there = np.ones(len(asked), bool)
        weight = np.zeros(len(asked), np.int64)
        base = len(self.labels) + 1
        for d in range(int(size.max(initial=0))):
            there &= size > d
            if d >= len(self.levels):
                break
            label, before, final = self.levels[d]
            word = np.array([number.get(w[d], NONE) if len(w) > d else NONE for w in asked], np.int64)
            keys, wanted = before.astype(np.int64) * base + label, at * base + word
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there &= (word != NONE) & (keys[found] == wanted)
            at = np.where(there, found, 0)
            weight = np.where(there & (size == d + 1), final[at], weight)
        return [w or None for w in weight.tolist()]

    def to_bytes(self) -> bytes:
        """Sizes, levels and labels as little-endian arrays, one after the other."""
        head = np.array([len(self.labels), len(self.levels), *(len(x[0]) for x in self.levels)], "<i8")
        sizes = np.array([len(x) for x in self.labels], "<u4")
        arrays = [a.astype(kind) for level in self.levels for a, kind in zip(level, ("<i4", "<i4", "<i8"))]
        return b"".join([head.tobytes(), *(a.tobytes() for a in arrays), sizes.tobytes(), *self.labels])

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        n, depth = np.frombuffer(data, "<i8", 2).tolist()
        counts = np.frombuffer(data, "<i8", depth, 16).tolist()
        at, levels = 16 + 8 * depth, []
        for count in counts:
            level = []
            for kind in ("<i4", "<i4", "<i8"):
                level.append(np.frombuffer(data, kind, count, at))
                at += count * np.dtype(kind).itemsize
            levels.append(tuple(level))
        sizes = np.frombuffer(data, "<u4", n, at).tolist()
        at += 4 * n
        labels = []
        for size in sizes:
            labels.append(data[at:at + size])
            at += size
        return cls(labels, levels)


def union(automata: Iterable[Transducer]) -> Transducer:
    """The automaton of all sequences, weights of equal ones summed."""
    automata = list(automata)
    labels = sorted(set().union(*(a.labels for a in automata)))
    number = {w: i for i, w in enumerate(labels)}
    depth = max((len(a.levels) for a in automata), default=0)
    rows, weights = [np.zeros((0, depth), np.int64)], [np.zeros(0, np.int64)]
    for a in automata:
        own = np.array([*(number[w] for w in a.labels), NONE], np.int64)  # NONE stays, as the last place
        r, w = a.rows()
        rows.append(np.pad(own[r], ((0, 0), (0, depth - r.shape[1])), constant_values=NONE))
        weights.append(w)
    return Transducer.from_rows(labels, *summed(np.concatenate(rows), np.concatenate(weights)))
