"""Equal windows brought together by sorting, however many there are.

Windows lie in the order of their key over as many tasks as there are; a key that very many windows have runs over
several of them. Within a task equal keys are neighbours. The keys that a task begins and ends with, two a task, may go on
in the next, and those that very many of its rows have aren't held until they end: their rows come out as they come, and one row more
tells what the task knows of the key. These are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm._scratch import written

#: Rows for ``shared``: a 16-byte key, the string a window stands in, its place there, the least and the next document that have it (the
#: least again where there is no other).
WINDOW = pa.schema([("key", pa.binary()), ("sid", pa.binary()), ("off", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])
WINDOW_DDL = "key binary, sid binary, off int, lo long, hi long"
_OUT = pa.schema([*WINDOW, ("least", pa.int64()), ("second", pa.int64())])
#: Rows of one key that a task holds to see where the key ends.
HELD_ROWS = 50_000
_NONE = np.iinfo(np.int64).max


def _starts(t: pa.Table) -> np.ndarray:
    """Where another key begins, the first row included."""
    column = t.column("key").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    at = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    key = np.frombuffer(column.buffers()[2], np.uint64, len(column) * 2, at).reshape(-1, 2)
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))


def _two_least(t: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the least document and the least other one, or the largest number where there is none."""
    lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
    least = np.minimum.reduceat(lo, starts)
    each = np.repeat(least, np.diff(np.append(starts, len(t))))
    other = np.where(lo > each, lo, np.where(hi > each, hi, _NONE))
    return least, np.minimum.reduceat(other, starts)


def _inner(t: pa.Table, starts: np.ndarray, least: np.ndarray, second: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of keys that begin and end here and have several documents."""
    size = np.diff(np.append(starts, len(t)))
    least, second = np.repeat(least, size), np.repeat(second, size)
    keep = np.flatnonzero(second < _NONE)
    if len(keep):
        some = t.take(pa.array(keep))
        cols = [pa.nulls(len(keep), pa.binary()), *(some.column(c).combine_chunks() for c in ("sid", "off", "lo", "hi")), pa.array(least[keep]), pa.array(second[keep])]
        yield from pa.table(cols, schema=_OUT).to_batches()


def _open(t: pa.Table) -> Iterator[pa.RecordBatch]:
    rest = [pa.nulls(len(t), pa.int64())] * 2
    yield from pa.table([*(c.combine_chunks() for c in t.select(WINDOW.names).columns), *rest], schema=_OUT).to_batches()


class _Run:
    """The rows of the key that a task is at."""

    def __init__(self, key: bytes, passing: bool, most: int):
        self.key, self.passing, self.most, self.least, self.second = key, passing, most, _NONE, _NONE
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        least, second = (int(x[0]) for x in _two_least(t, np.zeros(1, np.int64)))
        known = sorted({self.least, self.second, least, second} - {_NONE})
        self.least, self.second = known[0], known[1] if len(known) > 1 else _NONE
        self.held.append(t)
        self.rows += len(t)
        self.passing = self.passing or self.rows > self.most
        if self.passing:
            yield from self._out()

    def _out(self) -> Iterator[pa.RecordBatch]:
        for t in self.held:
            yield from _open(t)
        self.held = []

    def end(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.passing or last:
            yield from self._out()
            row = [self.key, b"", -1, self.least, self.least if self.second == _NONE else self.second, None, None]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _OUT, strict=True)], schema=_OUT)
        elif self.held:
            t = pa.concat_tables(self.held)
            yield from _inner(t, np.zeros(1, np.int64), np.array([self.least]), np.array([self.second]))


def _grouped(most: int):
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            starts = _starts(t)
            first, last = int(starts[1]) if len(starts) > 1 else len(t), int(starts[-1])
            key = batch.column("key")[0].as_py()
            if run is None:
                run = _Run(key, True, most)
            elif run.key != key:
                yield from run.end(False)
                run = _Run(key, False, most)
            yield from run.add(t.slice(0, first))
            if not last:
                continue
            yield from run.end(False)
            if first < last:
                inner, at = t.slice(first, last - first), starts[1:-1] - first
                yield from _inner(inner, at, *_two_least(inner, at))
            run = _Run(batch.column("key")[last].as_py(), False, most)
            yield from run.add(t.slice(last))
        if run is not None:
            yield from run.end(True)

    return grouped


def shared(windows: DataFrame) -> DataFrame:
    """(sid, off, lo, least, second): the windows (key, sid, off, lo, hi) whose key several documents have, with the two least
    of these documents."""
    placed = windows.repartitionByRange("key", "sid", "off").sortWithinPartitions("key")
    found = written(placed.mapInArrow(_grouped(HELD_ROWS), WINDOW_DDL + ", least long, second long"), "sorted")
    edges = found.where("key IS NOT NULL").select("key", "sid", "off", "lo", "hi")
    # a row a task and key, of at most two keys a task and those of more than HELD_ROWS rows
    known = edges.where("off < 0").select("key", F.explode(F.array("lo", "hi")).alias("d")).groupBy("key").agg(F.array_sort(F.collect_set("d")).alias("d"))
    bounds = known.where("size(d) > 1").select("key", F.get("d", F.lit(0)).alias("least"), F.get("d", F.lit(1)).alias("second"))
    edges = edges.where("off >= 0").join(bounds, "key")
    return found.where("key IS NULL").select("sid", "off", "lo", "least", "second").unionByName(edges.select("sid", "off", "lo", "least", "second"))
