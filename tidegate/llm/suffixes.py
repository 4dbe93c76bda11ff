"""Repeated passages by sparse suffix arrays.

Of all suffixes of the texts, in words, only those are kept that start at a minimiser: the k-word sequence of least hash in
some window. Two texts that share a passage of a window's length keep a suffix at the same place in it. A first count
over all texts drops suffixes whose k words occur in one document alone. The others are sorted, by what follows and by what
stands to the left. The common lengths of neighbours in the two orders give, for each number of words to the left, the classes
of suffixes that share these and the rest of a window to the right; a class with several documents is a match. No partner is
left out. A start that very many have isn't brought together: its suffixes, with each number of words to the left, are sorted
over all tasks by a 128-bit BLAKE2 digest of the window that they make, so that no task holds them all, and neighbours compared
there. What is found is exact, word for word, but for that digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm import _sorted, _text
from tidegate.llm._scratch import written
from tidegate.llm.superkmers import FLUSH_BYTES, _sliding_min, _windows, _words, _zipped, runs

WINDOW, SEED_WORDS = 50, 8
#: Suffixes of one start that are sorted together; where more have a start, they are sorted over all tasks.
GROUP_ROWS = 2000
#: Suffixes, of whole groups, that are compared at a time.
BATCH_ROWS = 4000


def anchors(words: _text.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the minimisers of a block."""
    h = words.hashes()
    n, reach = len(h), window - k + 1
    if n < window:
        e = np.zeros(0, np.int64)
        return e, e, e.view(np.uint64)
    rolled = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        rolled = _text.mix(rolled ^ h[i : n - k + 1 + i], i + 2)
    least = _sliding_min(rolled, reach)
    text = np.searchsorted(words.bounds, np.arange(n), "right") - 1
    inside = text[: len(least)] == text[window - 1 : window - 1 + len(least)]
    # the greatest of the least hashes of the windows around a place is its own exactly where it is a minimiser
    pad = np.zeros(reach - 1, np.uint64)
    around = np.concatenate([pad, np.where(inside, least, np.uint64(0)), pad])
    top = ~_sliding_min(~around, reach)
    at = np.flatnonzero((top == rolled) & (top > 0))
    return text[at], at - words.bounds[text[at]], rolled[at]


def _scanned(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _text.blocks(batch.column("text")):
                text, at, seed = anchors(block, window, k)
                if not len(text):
                    continue
                # one row for all places that a text has of a start: a text that repeats itself has very many
                order = np.lexsort((at, seed, text))
                text, at, seed = text[order], at[order], seed[order]
                cut = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])))
                places = pa.ListArray.from_arrays(pa.array(np.append(cut, len(text)).astype(np.int32)), pa.array(at.astype(np.int32)))
                take = pa.array(text[cut] + block.first)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("fp").take(take), pa.array(seed[cut].view(np.int64)), places], names=["id", "fp", "seed", "places"])

    return run


_RUN = "sid binary, packed binary, id long, fp long, at int"


def _hot_runs(window: int, k: int):
    """The stretches of text whose windows begin their least hash at one of the text's hot starts."""
    schema = pa.schema([("sid", pa.binary()), ("packed", pa.binary()), ("id", pa.int64()), ("fp", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for id, fp, blob, seeds in zip(*(batch.column(c) for c in ("id", "fp", "blob", "seeds")), strict=True):
                w, id, fp = _words(blob.as_py()), id.as_py(), fp.as_py()
                hot = np.array([s["seed"] for s in seeds.as_py()], np.int64)
                for block in _text.blocks(pa.array([b" ".join(w).decode()], pa.string())):
                    _, first, n, mini = runs(block, window, k)
                    found = np.isin(mini.view(np.int64), hot)
                    for at, m in zip(first[found].tolist(), n[found].tolist(), strict=True):
                        packed = b" ".join(w[at : at + m + window - 1])
                        out.append((hashlib.blake2b(packed, digest_size=16).digest(), packed, id, fp, at))
                        held += len(packed)
                        if held > FLUSH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _joined(window: int):
    """Windows of a stretch that several documents have, those next to each other as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for id, fp, at, found in zip(*(batch.column(c).to_pylist() for c in ("id", "fp", "at", "found")), strict=True):
                last = None
                for w in sorted(found, key=lambda w: w["off"]):
                    other = w["second"] if id == w["least"] else w["least"]
                    if last is not None and at + w["off"] <= last[2] + last[3]:
                        last[3], last[4] = at + w["off"] + window - last[2], min(last[4], other)
                    else:
                        last = [id, fp, at + w["off"], window, other]
                        out.append(last)
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["id", "fp", "at", "n", "other"])

    return run


_SUFFIX = "seed long, ahead binary, behind binary, id long, fp long, places array<int>"
_SUFFIX_ARROW = pa.schema([("seed", pa.int64()), ("ahead", pa.binary()), ("behind", pa.binary()), ("id", pa.int64()), ("fp", pa.int64()), ("places", pa.list_(pa.int32()))])


def _suffixes(window: int, k: int):
    """Each kept suffix, as far as a window reaches, and what stands before it, last word first; one row for all that a
    text has alike. A space ends each word, so that in byte order those with equal first words stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for id, fp, blob, found in zip(*(batch.column(c) for c in ("id", "fp", "blob", "seeds")), strict=True):
                w, id, fp = _words(blob.as_py()), id.as_py(), fp.as_py()
                for s in found.as_py():
                    alike: dict[tuple, list[int]] = {}
                    for at in s["places"]:
                        alike.setdefault((b" ".join([*w[at : at + window], b""]), b" ".join([*w[max(0, at - window + k) : at][::-1], b""])), []).append(at)
                    for (ahead, behind), places in alike.items():
                        out.append((s["seed"], ahead, behind, id, fp, places))
                        held += len(ahead) + len(behind)
                    if held > FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SUFFIX_ARROW, strict=True)], schema=_SUFFIX_ARROW)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SUFFIX_ARROW, strict=True)], schema=_SUFFIX_ARROW)

    return run


def _common(a: bytes, b: bytes) -> int:
    """Words that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return a.count(b" ", 0, n)
    lo, hi = 0, n  # the first lo bytes are equal, the first hi aren't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return a.count(b" ", 0, lo)


def _commons(seeds: list[int], texts: list[bytes], order: list[int]) -> np.ndarray:
    """Common words of each with the one before it in the order; -1 where another start begins."""
    return np.array([-1] + [_common(texts[i], texts[j]) if seeds[i] == seeds[j] else -1 for i, j in pairwise(order)], np.int64)


def _compared(window: int, k: int):
    """What each suffix shares with suffixes of other documents: for each number of words to the left, those with the
    same words there and the rest of a window to the right are a class, by the two orders' common lengths."""

    def groups(rows: list[tuple]) -> Iterator[tuple[int, int, int, int, int]]:
        seeds, ahead, behind, ids, fps, places = zip(*rows, strict=True)
        n, id = len(rows), np.array(ids, np.int64)
        back = np.array(sorted(range(n), key=lambda i: (seeds[i], behind[i])))
        right, left = _commons(seeds, ahead, range(n)), _commons(seeds, behind, back.tolist())
        most = np.maximum(right, np.append(right[1:], -1))
        most[back] += np.maximum(left, np.append(left[1:], -1))
        some = np.flatnonzero(most >= window)
        if not len(some):
            return
        low, high, other = np.full(n, window), np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
        of = np.empty(n, np.int64)
        for t in range(window - k + 1):
            of[back] = np.cumsum(left < t)
            of += np.cumsum(right < window - t) * (n + 1)
            o = some[np.lexsort((id[some], of[some]))]
            key, who = of[o], id[o]
            first = np.append(True, key[1:] != key[:-1])
            at = np.cumsum(first) - 1
            least, second, two = who[first], np.zeros(at[-1] + 1, np.int64), np.zeros(at[-1] + 1, bool)
            new = np.flatnonzero(~first & np.append(False, who[1:] != who[:-1]))[::-1]  # the first of a class is put last
            second[at[new]], two[at[new]] = who[new], True
            o, who, at = o[two[at]], who[two[at]], at[two[at]]
            low[o], high[o] = np.minimum(low[o], t), t
            other[o] = np.minimum(other[o], np.where(who == least[at], second[at], least[at]))
        for i in np.flatnonzero(high >= 0).tolist():
            a, b, c = int(high[i]), int(high[i] - low[i]) + window, int(other[i])
            for at in places[i]:
                yield ids[i], fps[i], at - a, b, c

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*groups(rows), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols or [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["id", "fp", "at", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BATCH_ROWS and held[-1][0] != r[0]:
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for id, spans in zip(batch.column("id").to_pylist(), batch.column("spans"), strict=True):
            for s in sorted(spans.as_py(), key=lambda s: s["at"]):
                if out and out[-1][0] == id and out[-1][4] is spans and s["at"] <= out[-1][1] + out[-1][2]:
                    last = out[-1]
                    last[2] = max(last[2], s["at"] + s["n"] - last[1])
                    last[3] = min(last[3], s["other"])
                else:
                    out.append([id, s["at"], s["n"], s["other"], spans])
        cols = list(zip(*out, strict=True))[:4] or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "at", "n", "other"])


def repeated_passages(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = SEED_WORDS) -> DataFrame:
    """One row per repeated passage of a document: id, start_word (from 0), n_words, other_id.

    A passage is a maximal span of words made of matches, each of at least ``window`` words, with documents of other
    ids; other_id is the smallest id among those. Nulls, short texts and rows with a null id have none;
    rows that repeat an id and a text count once. Other columns are left out; an empty table gives an empty table.
    """
    docs = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id IS NOT NULL")
    docs = docs.select("id", F.xxhash64("text").alias("fp"), "text")
    own = written(docs.mapInArrow(_scanned(window, k), "id long, fp long, seed long, places array<int>"), "anchors")
    shared = own.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum(F.size("places")).alias("c")).where("lo < hi")
    seed = F.struct("seed", F.when(F.col("c") <= GROUP_ROWS, F.col("places")).alias("places"))
    wanted = own.join(shared.select("seed", "c"), "seed").groupBy("id", "fp").agg(F.collect_set(seed).alias("seeds"))
    zipped = docs.mapInArrow(_zipped, "id long, fp long, blob binary")
    texts = written(zipped.join(wanted, ["id", "fp"]).dropDuplicates(["id", "fp"]), "texts")

    def having(hot: bool) -> DataFrame:
        return texts.withColumn("seeds", F.filter("seeds", lambda s: s["places"].isNull() == hot)).where("size(seeds) > 0")

    kept = having(False).mapInArrow(_suffixes(window, k), _SUFFIX).repartition("seed").sortWithinPartitions("seed", "ahead", "id")
    found = kept.mapInArrow(_compared(window, k), "id long, fp long, at int, n int, other long")
    stretches = having(True).mapInArrow(_hot_runs(window, k), _RUN)
    # the two least documents of a string; the limit is applied before the shuffle too
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("id"))
    two = stretches.select("sid", "id").distinct().withColumn("rank", rank).where("rank <= 2").groupBy("sid").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    strings = written(stretches.groupBy("sid").agg(F.first("packed").alias("packed")).join(two, "sid"), "strings")
    several = _sorted.shared(strings.mapInArrow(_windows(window), _sorted.WINDOW_DDL))
    several = several.groupBy("sid").agg(F.collect_set(F.struct("off", "least", "second")).alias("found"))
    hot = stretches.select("sid", "id", "fp", "at").join(several, "sid").mapInArrow(_joined(window), "id long, fp long, at int, n int, other long")
    found = written(found.unionByName(hot), "spans")
    spans = found.groupBy("id", "fp").agg(F.collect_set(F.struct("at", "n", "other")).alias("spans")).select("id", "spans")
    out = spans.mapInArrow(_united, "id long, at long, n long, other long")
    return out.select(F.col("id").alias(id), F.col("at").alias("start_word"), F.col("n").alias("n_words"), F.col("other").alias("other_id"))
