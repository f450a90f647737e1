"""Counting the n-grams of batches of texts, with numpy inside Spark tasks.

A gram is a number: the ids of its items side by side. Sorting (gram, row)
numbers gives the distinct grams of a batch, the rows that hold each one and how
often, and a string is built once per distinct gram of the batch, not once per
occurrence. Items are the characters of a text or its words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Items counted at a time; a task holds about 100 bytes for each.
BATCH_ITEMS = 1_000_000
NUMBER_BITS = 62
# White space as Java's (?U)\\s has it.
BLANKS = frozenset("\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | frozenset(map(chr, range(0x2000, 0x200B)))


@dataclass(frozen=True)
class Items:
    """Item ids of texts one after another; text r has those from starts[r] to starts[r + 1]."""

    starts: np.ndarray
    ids: np.ndarray
    names: list[str]  # the item of an id

    @classmethod
    def characters(cls, texts: list[str]) -> Items:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.flatnonzero(np.bincount(points)) if len(points) else np.empty(0, np.int64)
        place = np.zeros(int(found[-1]) + 1 if len(found) else 1, np.int64)
        place[found] = np.arange(len(found))
        return cls(np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64)), place[points], list(map(chr, found.tolist())))

    def without_marks(self) -> Items:
        """Characters decomposed, combining marks dropped: ``functions.text.strip_accents``."""
        folds = [[c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)] for name in self.names]
        if all(fold == [name] for fold, name in zip(folds, self.names, strict=True)):
            return self
        names = sorted({c for fold in folds for c in fold})
        place = {c: i for i, c in enumerate(names)}
        flat = np.array([place[c] for fold in folds for c in fold] + [-1], np.int64)
        widths = np.array([len(fold) for fold in folds], np.int64)
        firsts = np.cumsum(widths) - widths
        # One character for one is the rule; the others are put in or taken out.
        ids = np.where(widths > 0, flat[firsts], -1)[self.ids]
        odd = np.flatnonzero((widths != 1)[self.ids])
        if not len(odd):
            return Items(self.starts, ids, names)
        width, first = widths[self.ids[odd]], firsts[self.ids[odd]]
        more = np.maximum(width - 1, 0)
        rest = np.repeat(first + 1 - (np.cumsum(more) - more), more) + np.arange(more.sum())
        ids = np.insert(ids, np.repeat(odd + 1, more), flat[rest])
        shift = np.append(0, np.cumsum(width - 1))
        return Items(self.starts + shift[np.searchsorted(odd, self.starts)], ids[ids >= 0] if (width == 0).any() else ids, names)

    def with_single_blanks(self) -> Items:
        """Runs of two or more blanks made one space: ``functions.text.collapse_blanks``."""
        blank = np.array([name in BLANKS for name in self.names], bool)[self.ids] if self.names else np.empty(0, bool)
        more = np.append(False, blank[1:] & blank[:-1])[: len(blank)]
        more[self.starts[self.starts < len(more)]] = False
        if not more.any():
            return self
        names = self.names if " " in self.names else [*self.names, " "]
        heads = np.flatnonzero(more) - 1
        ids = self.ids.copy()
        ids[heads[~more[heads]]] = names.index(" ")
        return Items(np.append(0, np.cumsum(~more))[self.starts], ids[~more], names)

    @classmethod
    def words(cls, texts: list[str]) -> Items:
        """Words are parted by single spaces."""
        lists = [t.split(" ") if t else [] for t in texts]
        place: dict[str, int] = {}
        ids = np.array([place.setdefault(w, len(place)) for x in lists for w in x], dtype=np.int64)
        return cls(np.append(0, np.cumsum([len(x) for x in lists], dtype=np.int64)), ids, list(place))


@dataclass(frozen=True)
class Counts:
    """Distinct grams; gram g is in the rows[firsts[g] : firsts[g + 1]], ``times`` each.

    Its items are names[columns[0][g]], names[columns[1][g]] and so on.
    """

    columns: list[np.ndarray]
    names: list[str]
    sep: str
    firsts: np.ndarray
    rows: np.ndarray
    times: np.ndarray

    @property
    def terms(self) -> list[str]:
        name = self.names.__getitem__
        return list(map(self.sep.join, zip(*(map(name, c.tolist()) for c in self.columns), strict=True)))

    def strings(self) -> pa.Array:
        """The terms as an Arrow array; single characters need no Python string each."""
        if self.sep or any(len(name) != 1 for name in self.names):
            return pa.array(self.terms, pa.string())
        points = np.array(list(map(ord, self.names)), np.uint32)
        sizes = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.cumsum(sum(sizes[c] for c in self.columns), dtype=np.int32)
        data = points[np.stack(self.columns, axis=1)].astype("<u4").tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(np.int32(0), ends)), pa.py_buffer(data))


@dataclass(frozen=True)
class Lookup:
    """Numbers of known grams, found item by item as in a trie.

    ``levels[n]`` has the sorted numbers of the known beginnings of n + 1 items: the
    place of the n items before on its level, beside the id of the last one.
    ``numbers[n]`` is the number of the gram of a place, or -1.
    """

    items: dict[str, int]
    bits: int
    levels: list[np.ndarray]
    numbers: list[np.ndarray]

    @classmethod
    def of(cls, known: Items, numbers: np.ndarray) -> Lookup:
        """``known``: a gram a row, with the given numbers."""
        sizes, bits = np.diff(known.starts), _bits(len(known.names))
        place, levels, found = np.zeros(len(sizes), np.int64), [], []
        for n in range(int(sizes.max(initial=0))):
            at = np.flatnonzero(sizes > n)
            level, place[at] = np.unique(place[at] << bits | known.ids[known.starts[at] + n], return_inverse=True)
            last = at[sizes[at] == n + 1]
            levels.append(level)
            found.append(np.full(len(level), -1, np.int64))
            found[n][place[last]] = numbers[last]
        return cls({name: i for i, name in enumerate(known.names)}, bits, levels, found)

    def find(self, counts: Counts) -> np.ndarray:
        """The number of each distinct gram of ``counts``, or -1."""
        n = len(counts.columns)
        if n > len(self.levels):
            return np.full(len(counts.columns[0]), -1, np.int64)
        ids = np.array([self.items.get(name, -1) for name in counts.names], np.int64)
        place, known = np.zeros(len(counts.columns[0]), np.int64), np.full(len(counts.columns[0]), True)
        for level, column in zip(self.levels, counts.columns, strict=False):
            item = ids[column]
            wanted = place << self.bits | item
            place = np.minimum(np.searchsorted(level, wanted), len(level) - 1)
            known &= (item >= 0) & (level[place] == wanted)
        return np.where(known, self.numbers[n - 1][place], -1)


def _bits(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def counted(items: Items, low: int, high: int, sep: str) -> Iterator[Counts]:
    """The counts of all grams of ``low`` to ``high`` items, size by size."""
    sizes = np.diff(items.starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(items.starts[1:], sizes) - np.arange(len(items.ids))
    item_bits, row_bits = _bits(len(items.names)), _bits(len(sizes))
    # Numbers too wide for the next item are replaced by their rank; tables[n]
    # has the numbers of n items behind the ranks.
    numbers, width, tables = items.ids, item_bits, {}
    for n in range(1, high + 1):
        if n > 1:
            if width + item_bits + row_bits > NUMBER_BITS:
                tables[n - 1], numbers = np.unique(numbers, return_inverse=True)
                width = _bits(len(tables[n - 1]))
            numbers = (numbers[:-1] << item_bits) | items.ids[n - 1 :]
            width += item_bits
        if not len(numbers):
            return
        if n >= low:
            yield _sorted_counts(items, numbers, row, left[: len(numbers)] >= n, n, width, tables, item_bits, row_bits, sep)


def _sorted_counts(items, numbers, row, inside, n, width, tables, item_bits, row_bits, sep) -> Counts:
    behind = None
    if width + row_bits > NUMBER_BITS:
        behind, numbers = np.unique(numbers, return_inverse=True)
    both = ((numbers << row_bits) | row[: len(numbers)])[inside]
    if behind is None and width + row_bits < 32:
        both = both.astype(np.int32)  # sorted in half the time
    both.sort()
    pair = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    held = both[pair]
    times = np.diff(np.append(pair, len(both)))
    gram = held >> row_bits
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    distinct = gram[first] if behind is None else behind[gram[first]]
    columns = []
    for size in range(n, 0, -1):
        if size in tables and size < n:
            distinct = tables[size][distinct]
        last = distinct if size == 1 else distinct & ((1 << item_bits) - 1)
        columns.append(last)
        distinct = distinct >> item_bits
    return Counts(columns[::-1], items.names, sep, np.append(first, len(gram)), held & ((1 << row_bits) - 1), times)


def added(rows: list[np.ndarray], ids: list[np.ndarray], times: list[np.ndarray], n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, times) in this order, the times of equal pairs added up."""
    id_bits = _bits(n_ids)
    pair = np.concatenate([row << id_bits | i for row, i in zip(rows, ids, strict=True)])
    count = np.concatenate(times)
    time_bits = _bits(int(count.max(initial=0)) + 1)
    if _bits(int(pair.max(initial=0)) + 1) + time_bits <= NUMBER_BITS:
        both = pair << time_bits | count
        both.sort()
        pair, count = both >> time_bits, both & ((1 << time_bits) - 1)
    else:
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], count[order]
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    if len(starts) < len(pair):
        pair, count = pair[starts], np.add.reduceat(count, starts)
    return pair >> id_bits, pair & ((1 << id_bits) - 1), count


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` items, or of one row."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield low, high
        low = high
