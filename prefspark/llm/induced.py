"""Suffix sorting of a shard by external induced sorting.

Suffix tuples - a position and the rank of its first symbol - wait in a queue of
symbol ranges whose chunks go to disk beyond a memory limit.  Suffixes of the
leftmost-S kind are sorted by their leading symbols, some at a time; where those
tie for long, by induction of their substrings and recursion on the names.  They
induce all L suffixes in ascending and these all S suffixes in descending order.
The queue hands out as many tuples at a time as cannot be overtaken by what they
induce, so each step is a few array operations.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Tuples that queues hold in memory before chunks are written out.
MEMORY_ITEMS = 8 << 20
#: Times that leftmost S suffixes are told apart by a packed number of symbols more, before their substrings are induced.
ROUNDS = 32


class TupleQueue:
    """A priority queue of positions by symbol value; equal values keep the order of arrival."""

    def __init__(self, top: int, folder: str, memory_items: int, ranges: int):
        self.width = max(1, -(-(top + 1) // ranges))
        self.chunks: dict[int, list] = {}
        self.folder, self.memory_items = folder, memory_items
        self.held, self.files = 0, 0

    def push(self, values: np.ndarray, positions: np.ndarray) -> None:
        """Add tuples, in their order of rank."""
        ranges = values if self.width == 1 else values // self.width
        order = np.argsort(ranges, kind="stable")
        ranges, values, positions = ranges[order], values[order], positions[order]
        cuts = np.flatnonzero(ranges[1:] != ranges[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranges)]):
            if b > a:
                self.chunks.setdefault(int(ranges[a]), []).append((values[a:b], positions[a:b]))
        self.held += len(ranges)
        if self.held > self.memory_items:
            self._spill()

    def _spill(self) -> None:
        """Write every range's waiting tuples to a file of its own."""
        for chunks in self.chunks.values():
            inside = [c for c in chunks if not isinstance(c, str)]
            if inside:
                path = os.path.join(self.folder, f"{id(self)}-{self.files}.npy")
                self.files += 1
                np.save(path, np.stack([np.concatenate([c[k] for c in inside]) for k in (0, 1)]))
                chunks[:] = [c for c in chunks if isinstance(c, str)] + [path]
        self.held = 0

    def take(self) -> tuple[np.ndarray, np.ndarray, int] | None:
        """All tuples of the least range, in order, and the first value beyond it."""
        if not self.chunks:
            return None
        least = min(self.chunks)
        values, positions = [], []
        for chunk in self.chunks.pop(least):
            if isinstance(chunk, str):
                chunk = np.load(chunk)
                self.held += len(chunk[0])
            values.append(chunk[0])
            positions.append(chunk[1])
            self.held -= len(chunk[0])
        values, positions = np.concatenate(values), np.concatenate(positions)
        order = np.argsort(values, kind="stable")
        return values[order], positions[order], (least + 1) * self.width


def induce(symbols: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, folder: str, memory_items: int) -> np.ndarray:
    """Positions of the seeds and of all they induce, in ascending order.

    ``wanted`` marks the kind to induce; a position's predecessor of that kind has
    a symbol at least as large, and among equal symbols comes before the seeds.
    """
    value = 2 * symbols + ~wanted
    # Sorting 16 bits takes a pass or two over them.
    value = value.astype(np.uint16) if value.max() < np.iinfo(np.uint16).max else value.astype(np.int64)
    nothing = np.iinfo(value.dtype).max
    # As many ranges as a range has tuples: few rounds, and few tuples that overtake others in one.
    queue = TupleQueue(int(value.max()), folder, memory_items, max(16, int(len(symbols) ** 0.5)))
    queue.push(value[seeds], seeds)
    out = []
    while (taken := queue.take()) is not None:
        values, positions, bound = taken
        while len(values):
            before = positions - 1
            induces = (positions > 0) & wanted[before]
            new = np.where(induces, value[before], nothing)
            # A tuple may go out with those before it unless one of them induces a smaller one; equal ones all do.
            overtaken = np.flatnonzero(values[1:] > np.minimum.accumulate(new)[:-1]) if values[0] != values[-1] else ()
            stop = int(overtaken[0]) + 1 if len(overtaken) else len(values)
            out.append(positions[:stop])
            mine = induces[:stop]
            new, before = new[:stop][mine], before[:stop][mine]
            values, positions = values[stop:], positions[stop:]
            near = new < bound
            if near.any():
                values, positions = np.concatenate([values, new[near]]), np.concatenate([positions, before[near]])
                order = np.argsort(values, kind="stable")
                values, positions = values[order], positions[order]
            if not near.all():
                queue.push(new[~near], before[~near])
    return np.concatenate(out)


def _smaller_kind(symbols: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (kind S); the last counts as S."""
    n = len(symbols)
    differs = np.flatnonzero(symbols[:-1] != symbols[1:])
    small = np.zeros(n, bool)
    small[-1] = True
    if len(differs):
        small[: differs[-1] + 1] = np.repeat(symbols[differs] < symbols[differs + 1], np.diff(differs, prepend=-1))
    return small


def _packed(symbols: np.ndarray) -> tuple[np.ndarray, int, int]:
    """At each place the symbols from there on in one number, how many, and the bits of one; 0 follows the last."""
    bits = max(1, int(symbols.max()).bit_length())
    count = 63 // bits
    out = np.zeros(len(symbols) + 1, np.int64)
    for k in range(count):
        out <<= bits
        out[: max(0, len(symbols) - k)] |= symbols[k:]
    return out, count, bits


def _by_leading(symbols: np.ndarray, stars: np.ndarray) -> np.ndarray | None:
    """The stars in the order of their suffixes, or None where some still tie after ``ROUNDS``."""
    packed, count, _ = _packed(symbols)
    key = packed[stars]
    by_key = np.argsort(key)
    order, key = stars[by_key], key[by_key]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    spots, group = np.arange(len(order)), np.cumsum(new)
    for step in range(1, ROUNDS + 1):
        tied = ~new | ~np.append(new[1:], True)
        spots, group = spots[tied], group[tied]
        if not len(spots):
            return order
        key = packed[np.minimum(order[spots] + step * count, len(symbols))]
        by_key = np.argsort(key)
        ranks = np.empty(len(key), np.int64)
        ranks[by_key] = np.cumsum(np.diff(key[by_key], prepend=-1) != 0)
        both = group << 32 | ranks
        by_both = np.argsort(both)
        order[spots], both = order[spots[by_both]], both[by_both]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        group = np.cumsum(new)
    return None if not new.all() else order


def _both_ways(symbols: np.ndarray, small: np.ndarray, stars: np.ndarray, folder: str, memory_items: int) -> np.ndarray:
    """All positions in order, given the order of the leftmost S positions."""
    ascending = induce(symbols, ~small, stars, folder, memory_items)
    large = ascending[~small[ascending]][::-1]
    top = int(symbols.max())
    descending = induce(top - symbols, small, large, folder, memory_items)
    rest = np.array([len(symbols) - 1])  # the end mark is induced by nothing
    return np.concatenate([rest, descending[::-1]])


def suffix_order(symbols: np.ndarray, folder: str, memory_items: int = MEMORY_ITEMS) -> np.ndarray:
    """Positions of the suffixes in ascending order; ``symbols`` ends in a 0 that is its only one."""
    n = len(symbols)
    if n <= 2:
        return np.arange(n)[::-1]
    small = _smaller_kind(symbols)
    star = np.zeros(n, bool)
    star[1:] = small[1:] & ~small[:-1]
    stars = np.flatnonzero(star)
    if len(stars) <= 1:
        return _both_ways(symbols, small, stars, folder, memory_items)
    order = _by_leading(symbols, stars)
    if order is not None:
        return _both_ways(symbols, small, order, folder, memory_items)
    # The substrings between stars, sorted by one induction from stars in order of their first symbols.
    order = _both_ways(symbols, small, stars[np.argsort(symbols[stars], kind="stable")], folder, memory_items)
    order = order[star[order]]
    name_of = np.zeros(n, np.int64)
    name_of[order] = np.cumsum(_new_substrings(symbols, small, stars, order))
    names = name_of[stars]
    if names.max() < len(stars):  # some tie: sort the string of names, its last is again the least
        order = stars[suffix_order(names - 1, folder, memory_items)]
    return _both_ways(symbols, small, order, folder, memory_items)


def _new_substrings(symbols: np.ndarray, small: np.ndarray, stars: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each star's substring, through the next star, differs from the one before it in order."""
    n = len(symbols)
    length = np.zeros(n, np.int64)
    length[stars] = np.append(np.diff(stars), 0) + 1
    new = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    step = 0
    while len(left):  # symbol by symbol, for the pairs that still agree
        x, y = a[left] + step, b[left] + step
        agree = (symbols[x] == symbols[y]) & (small[x] == small[y])
        same[left[~agree]] = False
        left = left[agree & (length[a[left]] > step + 1)]
        step += 1
    new[1:] = ~same
    return new


def prefix_classes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Class of each place in ``order``; neighbours share one when ``length`` symbols agree."""
    packed, count, bits = _packed(symbols)
    new = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for done in range(0, length, count):  # some symbols at a time, for the neighbours that still agree
        unused = bits * max(0, done + count - length)
        a, b = (packed[np.minimum(order[x] + done, len(symbols))] >> unused for x in (left - 1, left))
        new[left[a != b]] = True
        left = left[a == b]
    return np.cumsum(new)


def sorted_windows(text: np.ndarray, length: int, memory_items: int = MEMORY_ITEMS) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, class of each) for a shard's symbols, which are 1 or more."""
    symbols = np.append(text.astype(np.int32), np.int32(0))
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        order = suffix_order(symbols, folder, memory_items)
    return order, prefix_classes(symbols, order, length)
