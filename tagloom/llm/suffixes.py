"""Removal of passages that an earlier document holds, by distributed prefix doubling.

A rank stands for the ``h`` bytes that follow a position, equal ranks for equal
bytes. Doubling pairs the rank at a position with the one ``h`` further on. The
first doublings, up to half the asked length, run in place on the bytes (8 at
once are their own rank; longer ones are 64-bit mixes of two ranks). From there
on Spark brings equal ranks together and documents are compared:

1. Half the length, at synchronising positions only. Of the half-length ranks
   that a full-length window holds, the smallest one belongs to the window's
   content alone; neighbouring windows with the same smallest rank form a block,
   about one for 14 positions at 50 bytes. Blocks are compared by (smallest rank,
   ranks at the block's ends). What is unique is dropped. A block whose
   whole content came earlier is settled; a first one is held if other blocks
   share its smallest rank.
2. The full length, at every window of the blocks held: (rank, smallest rank),
   compared again. A window is repeated if the first document of its equals is smaller.

Rows are dealt out by rank, in as many parts as the text needs, and travel packed:
one row of bytes for each part and quarter of a million rows. Each task first compares
the rows it has gathered and sends, of equal ones, only the first document's on; a passage that a
third of all documents hold then comes to a few rows a task. Blocks that share
a smallest rank in many contexts, as beside a common line, are spread by their
whole content and held; a mark tells the part of that rank. Shuffle files are
dropped after each of the two steps. Windows are equal when 128 bits of ranks are.
Shuffled rows are bounded by the text, not by pairs.

Null texts are empty; texts shorter than the length are kept whole. Rows that
share an id are one place in the order and never remove from each other, whatever
their texts; equal rows get equal results. A null id has no order: nothing is
removed there, and it removes nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import small_batches
from tagloom.session import store_table

CHUNK_BYTES = 1 << 20
RANGE_BYTES = 8 << 20  # text behind one part of the rows compared
GATHER_ROWS = 1 << 18  # rows that a task compares among themselves before it deals them out
MANY = 16  # more rows of one ``a`` among these are dealt out by (a, b)
_COUNT_BITS = 16  # a place is its first window's position, then how many windows follow
_MOST = (1 << _COUNT_BITS) - 1


def _mix(ranks: np.ndarray) -> np.ndarray:
    out = ranks * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def ranks(data: bytes, length: int, seed: int = 0) -> np.ndarray:
    """Rank of the ``length`` bytes at each position that has so many, by doubling."""
    if len(data) < length:
        return np.empty(0, dtype=np.uint64)
    have = min(8, 1 << (length.bit_length() - 1))
    found = np.ndarray((len(data) - have + 1,), dtype=f"<u{have}", buffer=data, strides=(1,)).astype(np.uint64)
    found += np.uint64(seed)
    while have < length:
        step = min(have, length - have)
        found = _mix(_mix(found[: len(found) - step]) + found[step:])
        have += step
    return _mix(found)


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """(text number, offset, joined bytes, sizes) of parts of about ``CHUNK_BYTES``.

    A long text is cut so that each of its windows lies whole in one part.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        for start in range(0, max(len(text) - length + 1, 0), CHUNK_BYTES):
            part = text[start : start + CHUNK_BYTES + length - 1]
            parts.append((number, start, part))
            size += len(part)
            if size >= CHUNK_BYTES:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    numbers, starts, data = zip(*parts, strict=True)
    return np.array(numbers), np.array(starts), b"".join(data), np.array([len(d) for d in data])


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, smallest rank, content rank, first window, windows) of every block."""
    half = (length + 1) // 2
    width = length - half + 1
    for numbers, starts, data, sizes in _chunks(texts, length):
        rank = ranks(data, half)
        least, have = rank, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        part = np.repeat(np.arange(len(sizes)), sizes)
        valid = part[: len(least)] == part[length - 1 :]
        change = valid.copy()
        change[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        begins = np.flatnonzero(change)
        runs = np.diff(np.append(np.flatnonzero(change[valid]), np.count_nonzero(valid)))
        # Long runs, as in periodic text, are cut every ``width`` windows.
        cuts = -(-runs // width)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        counts = np.minimum(width, np.repeat(runs, cuts) - nth * width)
        begins = np.repeat(begins, cuts) + nth * width
        content = _mix(_mix(_mix(rank[begins]) + rank[begins + length - half]) + rank[begins + counts - 1 + length - half])
        content += counts.astype(np.uint64)
        own = part[begins]
        offset = np.cumsum(sizes) - sizes
        yield numbers[own], least[begins], content, begins - offset[own] + starts[own], counts


def _array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]


_DEALT = "part int, rows binary"
_FOUND = "a long, doc_id long, tag long, place long, kind int"

# Kinds of rows on their way: SETTLED has a smaller document beside it already;
# SPREAD is one of many with its ``a`` and goes by (a, b); MARK tells the rows
# that go by this ``a`` of the spread ones.
PLAIN, SETTLED, SPREAD, MARK = 0, 1, 2, 3
# Kinds of rows found.
LATER, HELD = 0, 1

Rows = tuple[np.ndarray, ...]  # a, b, document, tag, place


def _block_rows(length: int, parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for batch in batches:
            ids, tags = _numbers(batch, "doc_id"), _numbers(batch, "tag")
            for number, least, content, first, counts in blocks(_bytes(batch), length):
                yield least, content, ids[number], tags[number], (first << _COUNT_BITS) | counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(rows(batches)):
            yield _dealt(*_spread(*found), parts)

    return run


def _window_rows(length: int, parts: int):
    """Rows of the single windows of the blocks held for each text."""
    half = (length + 1) // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for batch in batches:
            ids, tags = _numbers(batch, "doc_id"), _numbers(batch, "tag")
            held = batch.column("held")
            of = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            flat = held.flatten()
            least, place = flat.field("a").to_numpy(zero_copy_only=False), flat.field("place").to_numpy(zero_copy_only=False)
            texts = _bytes(batch)
            starts, counts = place >> _COUNT_BITS, place & _MOST
            for low in range(0, len(of), 1 << 13):
                span = slice(low, low + (1 << 13))
                cut = [texts[t][s : s + n + length - 1] for t, s, n in
                       zip(of[span].tolist(), starts[span].tolist(), counts[span].tolist(), strict=True)]
                rank = ranks(b"".join(cut), half, seed=1)
                n = counts[span]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                sizes = n + length - 1
                at = np.repeat(np.cumsum(sizes) - sizes, n) + nth
                whole = _mix(_mix(rank[at]) + rank[at + length - half])
                own = np.repeat(of[span], n)
                window = np.repeat(starts[span], n) + nth
                yield whole, np.repeat(least[span], n).view(np.uint64), ids[own], tags[own], (window << _COUNT_BITS) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(rows(batches)):
            yield _dealt(*_merged(*found, length), parts)

    return run


def _gathered(rows: Iterator[Rows]) -> Iterator[Rows]:
    """The same rows, about ``GATHER_ROWS`` at once."""
    parts: list[Rows] = []
    for found in rows:
        parts.append(found)
        if sum(len(p[0]) for p in parts) >= GATHER_ROWS:
            yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))
            parts = []
    if parts:
        yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _repeated(values: np.ndarray) -> np.ndarray:
    """Whether each value is there more than once."""
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _compared(rows: Rows, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows ``at`` ordered by all columns, where a group of equal (a, b) begins, and whether a smaller document is in the group."""
    at = at[np.lexsort([c[at] for c in reversed(rows)])]
    a, b, doc = (c[at] for c in rows[:3])
    head = _changes(a, b)
    return at, head, doc > doc[head][np.cumsum(head) - 1]


def _spread(*rows: np.ndarray) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Rows of blocks with their kind and the number they go by, what is settled among them marked.

    Where more than ``MANY`` rows that are not settled share ``a``, they go by (a, b).
    """
    a, b = rows[:2]
    kind, route = np.zeros(len(a), dtype=np.uint8), _mix(a)
    at, _, later = _compared(rows, np.flatnonzero(_repeated(a)))
    kind[at[later]] = SETTLED
    at = at[~later]
    new = np.flatnonzero(_changes(a[at]))
    sizes = np.diff(np.append(new, len(at)))
    many = at[np.repeat(sizes > MANY, sizes)]
    kind[many], route[many] = SPREAD, _mix(route[many] + b[many])
    marks = at[new[sizes > MANY]]
    if not len(marks):
        return rows, kind, route
    return (tuple(np.append(c, c[marks]) for c in rows), np.append(kind, np.full(len(marks), MARK, dtype=np.uint8)),
            np.append(route, _mix(a[marks])))


def _merged(a: np.ndarray, b: np.ndarray, doc: np.ndarray, tag: np.ndarray, place: np.ndarray, length: int) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Rows of windows as in ``_spread``. Equal windows of one text that touch become one
    place, as in periodic text: they are settled together and cover what lies between."""
    rows = (a, b, doc, tag, place)
    at, head, later = _compared(rows, np.flatnonzero(_repeated(a)))
    alone = np.ones(len(a), dtype=bool)
    alone[at] = False
    start = place[at] >> _COUNT_BITS
    fresh = head | _changes(doc[at], tag[at])
    fresh[1:] |= np.diff(start) > length
    run = np.flatnonzero(fresh)
    piece = (start - np.repeat(start[run], np.diff(np.append(run, len(at))))) // (_MOST // 2)
    run = np.flatnonzero(fresh | _changes(piece))
    last = np.append(run, len(at))[1:] - 1
    joined = (start[run] << _COUNT_BITS) | (start[last] - start[run] + 1)
    single = np.flatnonzero(alone)
    pick = np.append(single, at[run])
    kind = np.append(np.zeros(len(single), dtype=np.uint8), np.where(later[run], SETTLED, PLAIN).astype(np.uint8))
    rows = (a[pick], b[pick], doc[pick], tag[pick], np.append(place[single], joined))
    return rows, kind, _mix(rows[0])


def _dealt(rows: Rows, kind: np.ndarray, route: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each part, with all rows that go there as bytes: column by column, the numbers
    after ``a`` and ``b`` with their bytes of equal weight side by side, which Spark's compression shrinks."""
    settled = kind == SETTLED
    a, b, doc, tag, place = rows
    a, b = np.where(settled, np.uint64(0), a), np.where(settled, np.uint64(0), b)
    part = (((np.where(settled, _mix(doc.view(np.uint64)), route) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part = part[order]
    begins = np.flatnonzero(_changes(part))
    columns = [a[order].view(np.uint8).reshape(-1, 8), b[order].view(np.uint8).reshape(-1, 8)]
    planes = [np.ascontiguousarray(c[order].view(np.uint8).reshape(-1, 8).T) for c in (doc, tag, place)]
    kind = kind[order]
    packed = [
        b"".join([*(c[s:e].tobytes() for c in columns), *(p[:, s:e].tobytes() for p in planes), kind[s:e].tobytes()])
        for s, e in zip(begins.tolist(), [*begins[1:].tolist(), len(part)], strict=True)
    ]
    return pa.RecordBatch.from_arrays([pa.array(part[begins]), pa.array(packed, pa.binary())], names=["part", "rows"])


def _undealt(packed: pa.Buffer) -> Rows:
    """(a, b, document, tag, place, kind) of the bytes of one row."""
    data = np.frombuffer(packed, dtype=np.uint8)
    n = len(data) // 41
    a, b = data[: 8 * n].copy().view(np.uint64), data[8 * n : 16 * n].copy().view(np.uint64)
    planes = (np.ascontiguousarray(data[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view(np.int64).ravel() for i in (2, 3, 4))
    return a, b, *planes, data[40 * n :]


def _found(rows: Rows, at: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(at), 1 << 17):
        own = at[low : low + (1 << 17)]
        a = rows[0][own] if kind == HELD else np.zeros(len(own), dtype=np.uint64)
        columns = [_array(c) for c in (a, *(r[own] for r in rows[2:5]))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(own), kind, dtype=np.int32))], names=["a", "doc_id", "tag", "place", "kind"])


def _judged(hold_first: bool):
    """Rows of one part that matter, with ``kind``.

    LATER: a smaller document holds the same (a, b). With ``hold_first``, HELD: the first
    document's rows of a group that shares ``a`` with another one, or that was spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            for packed in batch.column("rows"):
                part = _undealt(packed.as_buffer())
                settled = part[5] == SETTLED
                yield from _found(part, np.flatnonzero(settled), LATER)
                kept.append(tuple(c[~settled] for c in part))
            del batch, packed, part
        if not kept:
            return
        *rows, kind = (np.concatenate(c) for c in zip(*kept, strict=True))
        kept.clear()
        at, head, later = _compared(rows, np.flatnonzero(_repeated(rows[0]) | (kind != PLAIN)))
        own = kind[at] != MARK
        yield from _found(rows, at[later & own], LATER)
        if hold_first and len(at):
            classes = np.cumsum(_changes(rows[0][at])) - 1
            shared = (np.bincount(classes, head) > 1) | (np.bincount(classes, kind[at] != PLAIN) > 0)
            yield from _found(rows, at[~later & own & shared[classes]], HELD)

    return run


def _compare_all(rows: DataFrame, parts: int, hold_first: bool, name: str) -> DataFrame:
    found = rows.repartitionById(parts, F.col("part")).mapInArrow(_judged(hold_first), _FOUND)
    return store_table(found, name, free=True)


def _numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(doc_id, tag, text) and the number of bytes; ``tag`` tells texts of one id apart."""
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = F.xxhash64("text")
    ids = store_table(wanted.groupBy("doc_id").agg(
        F.min(own).alias("low"), F.max(own).alias("high"), F.sum(F.octet_length("text")).alias("bytes")), "ids")
    size = ids.agg(F.sum("bytes")).first()[0] or 0
    several = ids.where(F.col("low") < F.col("high")).select("doc_id", F.lit(True).alias("several"))
    if several.isEmpty():
        return wanted.select("doc_id", F.lit(0).cast("long").alias("tag"), "text"), size
    return wanted.join(several, "doc_id", "left").select(
        "doc_id", F.when(F.col("several"), own).otherwise(F.lit(0)).alias("tag"), "text"), size


def repeated_windows(docs: DataFrame, size: int, length: int) -> DataFrame:
    """(doc_id, tag, place): places cover what all windows cover that a smaller ``doc_id`` holds too.

    ``docs`` has ``doc_id``, ``tag`` and ``text``; ``size`` is its text in bytes,
    which sets the number of parts. Stored when it returns.
    """
    if not 2 <= length <= _MOST:
        raise ValueError(f"a length from 2 to {_MOST} is needed")
    known = docs.where(F.col("doc_id").isNotNull())
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    found = _compare_all(known.mapInArrow(_block_rows(length, parts), _DEALT), parts, True, "blocks")
    held = found.where(F.col("kind") == HELD).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("a", "place")).alias("held"))
    windows = known.join(held, ["doc_id", "tag"]).mapInArrow(_window_rows(length, parts), _DEALT)
    singles = _compare_all(windows, parts, False, "windows")
    return found.where(F.col("kind") == LATER).unionByName(singles).select("doc_id", "tag", "place")


def _cover(size: int, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the windows cover."""
    starts = places >> _COUNT_BITS
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    reach = np.maximum.accumulate(starts + (places[order] & _MOST) - 1 + length)
    fresh = np.append(True, starts[1:] > reach[:-1])
    return starts[fresh], np.append(reach[:-1][fresh[1:]], reach[-1])


def remove_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans ARRAY<STRUCT<start, end>>, kept BINARY), a row per document.

    ``spans`` are the maximal runs of bytes covered by strings of ``length`` bytes
    that also start in a document with a smaller id, judged on the input;
    ``kept`` is the rest. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    numbered, size = _numbered(docs, doc_id, text)
    places = repeated_windows(numbered, size, length).groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            lists = batch.column("places")
            for row, data in enumerate(_bytes(batch)):
                found = lists[row]
                if not found.is_valid:
                    spans.append([])
                    kept.append(data)
                    continue
                starts, ends = _cover(len(data), found.values.to_numpy(zero_copy_only=False), length)
                spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
                before = [0, *ends.tolist()]
                kept.append(b"".join(data[s:e] for s, e in zip(before, [*starts.tolist(), len(data)], strict=True)))
            size = batch.column("text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.compute.binary_length(size).cast(pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    joined = numbered.join(places, ["doc_id", "tag"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
