"""Substring dedup over windows of words, by super-k-mer partitioning.

Consecutive windows of a text that share a minimiser (the least hash of their k-word sequences) form a run.
A window that two documents have gives both a run with the same minimiser, so only minimisers found in two documents
matter; these come from counting, over all texts, before any text moves. Runs of the others end there. A run then
travels as one packed string to the bucket of its minimiser, where its windows are sorted and counted as they are.

A minimiser with more than ``most_runs`` runs (a passage that very many documents hold) would make a bucket of
any size. Its runs are first reduced to distinct strings with the least document of each, and the windows of those
are sorted and counted over all tasks, under a 128-bit BLAKE2 digest, which stands for the window there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _sorted, _text
from tidegate.llm._scratch import written

WINDOW, SEED_WORDS, MOST_RUNS = 50, 8, 200
#: Bytes of packed strings in a batch.
FLUSH_BYTES = 1 << 22


def _sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Least of a[i : i + n], for every i with n values from there on."""
    if len(a) < n:
        return a[:0]
    size, out = 1, a
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(words: _text.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimiser) of the runs of a block.

    A run has at most as many windows as can hold one place: where a text repeats a minimiser without end, the run is cut.
    """
    h = words.hashes()
    n = len(h)
    if n < window:
        e = np.zeros(0, np.int64)
        return e, e, e, e.view(np.uint64)
    rolled = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        rolled = _text.mix(rolled ^ h[i : n - k + 1 + i], i + 2)
    least = _sliding_min(rolled, window - k + 1)
    count = np.maximum(np.diff(words.bounds) - window + 1, 0)
    text = np.repeat(np.arange(words.n), count)
    first = np.zeros(words.n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    place = np.arange(first[-1]) - first[text]
    mini = least[words.bounds[text] + place]
    if not len(mini):
        return text, place, place, mini
    new = np.ones(len(mini), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    n, reach = np.diff(np.append(at, len(mini))), window - k + 1
    pieces = -(-n // reach)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    n = np.minimum(np.repeat(n, pieces) - piece * reach, reach)
    at = np.repeat(at, pieces) + piece * reach
    return text[at], place[at], n, mini[at]


_SCAN = "id long, fp long, n_words long, sha string, mini long, at int, n int"


def _scanned(window: int, k: int):
    """A row for each text (words, digest of all of them) and one for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id, fp, column = batch.column("id"), batch.column("fp"), batch.column("text")
            for block in _text.blocks(column):
                part = slice(block.first, block.first + block.n)
                own = column.slice(block.first, block.n).fill_null("")
                sha = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split())).hexdigest() for t in own]
                ids, fps, none = id.slice(part.start, block.n), fp.slice(part.start, block.n), lambda m, t: pa.nulls(m, t)
                m = block.n
                yield pa.RecordBatch.from_arrays([ids, fps, pa.array(np.diff(block.bounds)), pa.array(sha), none(m, pa.int64()), none(m, pa.int32()), none(m, pa.int32())], names=["id", "fp", "n_words", "sha", "mini", "at", "n"])
                text, at, n, mini = runs(block, window, k)
                known = ids.is_valid().to_numpy(zero_copy_only=False)[text]
                text, at, n, mini = text[known], at[known], n[known], mini[known]
                if m := len(text):
                    take = pa.array(text)
                    yield pa.RecordBatch.from_arrays([ids.take(take), fps.take(take), none(m, pa.int64()), none(m, pa.string()), pa.array(mini.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "fp", "n_words", "sha", "mini", "at", "n"])

    return run


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blob = [z.compress((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), pa.array(blob, pa.binary())], names=["id", "fp", "blob"])


def _words(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split()


_PACKED = "mini long, packed binary, sid binary, id long, fp long, at int, n int, hot boolean"


def _packed(window: int):
    names = [x.split()[0] for x in _PACKED.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for id, fp, blob, found in zip(*(batch.column(c) for c in ("id", "fp", "blob", "runs")), strict=True):
                w, id, fp = _words(blob.as_py()), id.as_py(), fp.as_py()
                for r in found.as_py():
                    p = b" ".join(w[r["at"] : r["at"] + r["n"] + window - 1])
                    sid = hashlib.blake2b(p, digest_size=16).digest() if r["hot"] else None
                    out.append((r["mini"], p, sid, id, fp, r["at"], r["n"], r["hot"]))
                    held += len(p)
                    if held > FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _counted(window: int):
    """Windows of a bucket, sorted; those whose least document is smaller are covered. Buckets follow each other."""

    def bucket(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        found = []
        for r, (_, packed, id, _, at, n) in enumerate(rows):
            w = packed.split(b" ")
            found += [(b" ".join(w[j : j + window]), id, r, at + j) for j in range(n)]
        found.sort()
        covered: dict[int, list[int]] = {}
        for _, same in groupby(found, key=lambda x: x[0]):
            least = None
            for _, id, r, at in same:  # sorted by document within a window
                least = id if least is None else least
                if id > least:
                    covered.setdefault(r, []).append(at)
        for r, at in covered.items():
            at.sort()
            lo = 0
            for i in range(1, len(at) + 1):
                if i == len(at) or at[i] != at[i - 1] + 1:
                    yield rows[r][2], rows[r][3], at[lo], i - lo
                    lo = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flushed(rows: list[tuple]) -> pa.RecordBatch:
            out = list(bucket(rows)) if len(rows) > 1 else []
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "fp", "at", "n"])

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for mini, same in groupby(rows, key=lambda r: r[0]):
                if held and held[0][0] != mini:
                    yield flushed(held)
                    held = []
                held += same
        if held:
            yield flushed(held)

    return run


def _windows(window: int):
    """The windows of distinct strings, as rows to be sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, sid, off, lo, hi = [], [], [], [], []
            for s, p, a, b in zip(*(batch.column(c).to_pylist() for c in ("sid", "packed", "lo", "hi")), strict=True):
                w = p.split(b" ")
                n = len(w) - window + 1
                key += [_wid(w[j : j + window]) for j in range(n)]
                sid += [s] * n
                off += range(n)
                lo += [a] * n
                hi += [b] * n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((key, sid, off, lo, hi), _sorted.WINDOW, strict=True)], schema=_sorted.WINDOW)

    return run


def _wid(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _removed(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, sha, kept = [], [], []
            for blob, covered in zip(batch.column("blob"), batch.column("covered"), strict=True):
                w = _words(blob.as_py())
                depth = np.zeros(len(w) + 1, np.int64)
                for c in covered.as_py():
                    depth[c["at"]] += 1
                    depth[c["at"] + c["n"] + window - 1] -= 1
                stay = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                text = b" ".join([w[i] for i in stay])
                n_removed.append(len(w) - len(stay))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["__id", "__fp", "__removed", "__sha", "__kept"])

    return run


def _intervals(offs: str) -> Column:
    """Runs of consecutive numbers in an array of at most a run's windows, as structs of at and n."""
    x = F.col(offs)
    starts = F.array_sort(F.filter(x, lambda o: ~F.array_contains(x, o - 1)))
    ends = F.array_sort(F.filter(x, lambda o: ~F.array_contains(x, o + 1)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n")))


def covered_windows(df: DataFrame, id: str, text: str, window: int, k: int, most_runs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts: id, fp, n_words, sha), (covered: id, fp, at, n: windows at .. at + n - 1) and (id, fp, blob) of the
    texts that have a run which may be shared."""
    docs = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("fp"), "text")
    scan = written(docs.mapInArrow(_scanned(window, k), _SCAN), "runs")
    own = scan.where("mini IS NOT NULL").select("mini", "id", "fp", "at", "n")
    shared = own.groupBy("mini").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("mini", (F.col("c") > most_runs).alias("hot"))
    wanted = own.join(shared, "mini").groupBy("id", "fp").agg(F.collect_set(F.struct("mini", "at", "n", "hot")).alias("runs"))
    zipped = docs.where("id IS NOT NULL").mapInArrow(_zipped, "id long, fp long, blob binary")
    subset = written(zipped.join(wanted, ["id", "fp"]).dropDuplicates(["id", "fp"]), "texts")

    def packed(hot: bool) -> DataFrame:
        some = subset.select("id", "fp", "blob", F.filter("runs", lambda r: r["hot"] == hot).alias("runs"))
        return some.where("size(runs) > 0").mapInArrow(_packed(window), _PACKED)

    cold = packed(False).select("mini", "packed", "id", "fp", "at", "n").repartition("mini").sortWithinPartitions("mini")
    found = cold.mapInArrow(_counted(window), "id long, fp long, at int, n int")
    hot = packed(True)
    strings = written(hot.groupBy("sid").agg(F.first("packed").alias("packed"), F.min("id").alias("lo"), F.min("id").alias("hi")), "strings")
    # a window's least document is its string's own or, where another string has the window, a smaller one
    earlier = _sorted.shared(strings.mapInArrow(_windows(window), _sorted.WINDOW_DDL)).where("lo > least").groupBy("sid").agg(F.collect_set("off").alias("offs"))
    occurs = hot.select("sid", "id", "fp", "at", "n").join(strings.select("sid", F.col("lo").alias("least")), "sid")
    # of a string's later documents every window is covered, of its first those that are earlier elsewhere
    found = found.unionByName(occurs.where("id > least").select("id", "fp", "at", "n"))
    first = occurs.where("id = least").join(earlier, "sid").select("id", "fp", "at", F.explode(_intervals("offs")).alias("i"))
    found = found.unionByName(first.select("id", "fp", (F.col("at") + F.col("i.at")).alias("at"), F.col("i.n").alias("n")))
    return scan.where("mini IS NULL").select("id", "fp", "n_words", "sha"), found, subset.select("id", "fp", "blob")


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = SEED_WORDS, most_runs: int = MOST_RUNS, texts: bool = False) -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_sha256 (and kept_text, null where nothing went, if ``texts``).

    Words covered by a window that also starts in a row with a smaller id go; windows are those of the input. Nulls
    and texts shorter than a window keep all; rows with a null id neither lose words nor take any; rows that share an
    id don't take from each other. Other columns are left out; an empty table gives an empty table.
    """
    all_, covered, subset = covered_windows(df, id, text, window, k, most_runs)
    spans = covered.groupBy("id", "fp").agg(F.collect_set(F.struct("at", "n")).alias("covered"))
    changed = subset.join(spans, ["id", "fp"]).mapInArrow(_removed(window, texts), "__id long, __fp long, __removed long, __sha string, __kept string")
    changed = written(changed, "changed")
    out = all_.join(changed, (F.col("id") == F.col("__id")) & (F.col("fp") == F.col("__fp")), "left")
    return out.select(F.col("id").alias(id), "n_words", F.coalesce("__removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__sha", "sha").alias("kept_sha256"), *([F.col("__kept").alias("kept_text")] if texts else []))
