"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A text's set is its distinct word shingles, as 64-bit hashes. Texts with the same set (a 128-bit digest of all
of it, whose first half numbers it) are one class. Shingles are ordered by an estimated frequency, rarest first; the estimate is a count sketch of
fixed size, and any order that all texts share is right. Two sets that are similar enough share a shingle in
short prefixes of that order, so classes meet by prefix shingles, and pairs pass

- the length filter, on set sizes,
- the positional filter, on what can still follow the shingle in both,
- the suffix filter: parity bitmaps of both sets bound their Hamming distance from below,

before their sets are intersected. The result is components, so pairs inside one need no test: a first round
tests a few likely neighbours of each class in each prefix shingle, a second all pairs that lie in different
components by then. A group of near copies thus never becomes all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _text, _worker
from tidegate.llm._scratch import written
from tidegate.llm.components import components

SHINGLE, THRESHOLD = 5, (80, 100)
#: log2 of the sketch's counters; rows of a shingle kept to compare with those that follow; neighbours tried in either order.
SKETCH_BITS, GROUP_ROWS, NEIGHBOURS = 18, 2000, 3
#: A shingle estimated more frequent than this is dealt to several groups.
HOT = 20_000
#: Parts of the sketch, and how many tasks' counts of a part are summed at a time.
SKETCH_PARTS, FAN_IN = 64, 128
#: Rows that a task writes of classes, and of texts.
TASK_CLASSES, TASK_BODIES = 50_000, 5_000


def _ceil(a, b):
    return -(-a // b)


class Bounds:
    """Exact bounds for den * |I| >= num * |U|."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def probe(self, n):
        return n - _ceil(self.num * n, self.den) + 1

    def index(self, n):
        return n - _ceil(2 * self.num * n, self.num + self.den) + 1

    def overlap(self, a, b):
        return _ceil(self.num * (a + b), self.num + self.den)


def _sets(column: pa.Array, n: int, lower: bool) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for block in _text.blocks(column, lower):
        h, bounds = _text.shingles(block, n)
        for i in range(block.n):
            yield np.unique(h[bounds[i] : bounds[i + 1]])


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


_SCAN = "id long, key long, key2 int, n long, fp binary, c long, b0 long, b1 long, b2 long, b3 long, part int, counts binary"
_SCAN_ARROW = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("key2", pa.int32()), ("n", pa.int64()), ("fp", pa.binary()), *((x, pa.int64()) for x in ("c", "b0", "b1", "b2", "b3")), ("part", pa.int32()), ("counts", pa.binary())])


def _class(fp: bytes | None) -> int | None:
    return None if fp is None else int.from_bytes(fp[:8], "big", signed=True)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _scanned(n: int, lower: bool):
    """A row for each text, with its class and parity bitmap, and at the end the task's own sketch, in parts under its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker.begins("jaccard")
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            size, fp, bits, slots = [], [], np.zeros((batch.num_rows, 256), np.uint8), []
            for i, s in enumerate(_sets(batch.column("text"), n, lower)):
                size.append(len(s))
                fp.append(_digest(s))
                bits[i] = np.bincount((_text.mix(s, 7) & np.uint64(255)).astype(np.int64), minlength=256) & 1
                slots.append(_slot(s))
            if slots:
                sketch += np.bincount(np.concatenate(slots), minlength=len(sketch))
            packed, m = np.packbits(bits, axis=1).view(np.int64), len(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), batch.column("key2"), pa.array(size, pa.int64()), pa.array(fp, pa.binary()), pa.array([_class(f) for f in fp], pa.int64()), *(pa.array(packed[:, k]) for k in range(4)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                schema=_SCAN_ARROW,
            )
        parts, task = [p.tobytes() for p in np.split(sketch, SKETCH_PARTS)], np.full(SKETCH_PARTS, TaskContext.get().partitionId(), np.int64)
        blank = [pa.nulls(SKETCH_PARTS, f.type) for f in list(_SCAN_ARROW)[2:-2]]
        yield pa.RecordBatch.from_arrays([blank[0], pa.array(task), *blank, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=_SCAN_ARROW)
        _worker.ends()

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("counts"))
    return pa.table({"part": table.column("part").slice(0, 1), "task": table.column("task").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(scan: DataFrame) -> np.ndarray:
    """The tasks' sketches summed in a tree: no step holds more than FAN_IN of a part, however many tasks there are, and
    the driver gets one sketch."""
    parts = scan.where("part IS NOT NULL").select("part", F.col("key").alias("task"), "counts")
    n = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        n = _ceil(n, FAN_IN)
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("long")).groupBy("part", "task").applyInArrow(_summed, "part int, task long, counts binary")
        if n == 1:
            break
    found = sorted(parts.collect(), key=lambda r: r.part)
    return np.concatenate([np.frombuffer(r.counts, np.int64) for r in found]) if found else np.zeros(1 << SKETCH_BITS, np.int64)


def _postings(n: int, lower: bool, bounds: Bounds, sketch: np.ndarray):
    """(shingle, class, set size << 28 | place, group) of the prefixes; a task sends each class once. A shingle has a group for each HOT
    of its estimated texts, and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        _worker.begins("jaccard")
        for batch in batches:
            token, c, word, hot = [], [], [], []
            for s in _sets(batch.column("text"), n, lower):
                if not len(s) or (own := _class(_digest(s))) in seen:
                    continue
                seen.add(own)
                often = sketch[_slot(s)]
                first = np.lexsort((s, often))[: bounds.probe(len(s))]
                groups = often[first] // HOT
                hot.append(np.where(groups > 0, 1 + own % np.maximum(groups, 1), 0))
                token.append(s[first].view(np.int64))
                c.append(np.full(len(first), own))
                word.append(len(s) << 28 | np.arange(len(first)))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, c, word, hot)], names=["token", "c", "w", "hot"])
        _worker.ends()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, sorted by shingle and class, without repeats, whose shingle another class has too; those dealt to
    several groups all stay."""
    held, stays = None, False
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token, c, w, hot = (batch.column(k).to_numpy() for k in ("token", "c", "w", "hot"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
        token, c, w, hot = token[new], c[new], w[new], hot[new]
        same = token[1:] == token[:-1]
        keep = hot > 0
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= stays
        held, stays = pa.RecordBatch.from_arrays([pa.array(x[-1:]) for x in (token, c, w, hot)], names=["token", "c", "w", "hot"]), bool(keep[-1])
        k = np.flatnonzero(keep[:-1])
        yield _posting_batch(token[k], c[k], w[k], hot[k])
    if held is not None and stays:
        yield _posting_batch(*(held.column(k).to_numpy() for k in ("token", "c", "w", "hot")))


def _posting_batch(token: np.ndarray, c: np.ndarray, w: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    low = (1 << 28) - 1
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (token, c, w >> 28, w & low, hot)], names=["token", "c", "n", "pos", "hot"])


def _distance(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) for x, y in zip(a, b, strict=True))


def _likely(bounds: Bounds):
    """A few pairs of each shingle's classes that pass the filters: neighbours by size and by bitmap, and the first."""

    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        token, c, n, pos = (t.column(k).to_numpy() for k in ("token", "c", "n", "pos"))
        bits = [t.column(f"b{k}").to_numpy() for k in range(4)]
        left, right = [], []
        by_size = np.lexsort((c, n, token))
        for order in (by_size, np.lexsort((c, *reversed(bits), token))):
            for step in range(1, min(NEIGHBOURS, len(c) - 1) + 1):
                left.append(order[:-step])
                right.append(order[step:])
        new = np.flatnonzero(np.append(True, token[by_size][1:] != token[by_size][:-1]))
        left.append(by_size[np.repeat(new, np.diff(np.append(new, len(c))))])
        right.append(by_size)
        a, b = np.concatenate(left), np.concatenate(right)
        same = (token[a] == token[b]) & (c[a] != c[b])
        a, b = a[same], b[same]
        turn = (n[a] > n[b]) | ((n[a] == n[b]) & (c[a] > c[b]))
        a, b = np.where(turn, b, a), np.where(turn, a, b)  # a is the smaller set
        need = bounds.overlap(n[a], n[b])
        ok = (bounds.den * n[a] >= bounds.num * n[b]) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need)
        ok &= _distance([x[a] for x in bits], [x[b] for x in bits]) <= n[a] + n[b] - 2 * need
        return c[a[ok]], c[b[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None  # of the last shingle, which may go on
        for batch in batches:
            t = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])]).combine_chunks()
            yield _pairs_batch(*pairs(t))
            token = t.column("token").to_numpy()
            first = max(int(np.searchsorted(token == token[-1], True)), len(token) - GROUP_ROWS)
            tail = t.slice(first).combine_chunks()
        _worker.ends()

    return run


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blob = [z.compress((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("key2"), pa.array(blob, pa.binary())], names=["own", "key2", "blob"])


def _verified(n: int, lower: bool, bounds: Bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, last, mine = zstandard.ZstdDecompressor().decompress, None, None
        _worker.begins("jaccard")
        for batch in batches:
            out = []
            theirs = _sets(pa.array([unzip(x.as_py()).decode() for x in batch.column("blob_b")], pa.string()), n, lower)
            for a, blob, other in zip(batch.column("a").to_pylist(), batch.column("blob_a"), theirs, strict=True):
                if a != last:
                    last, mine = a, next(_sets(pa.array([unzip(blob.as_py()).decode()], pa.string()), n, lower))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                out.append(bounds.den * both >= bounds.num * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "linked"])
        _worker.ends()

    return run


def _crossing(postings: DataFrame, member: DataFrame, bounds: Bounds) -> DataFrame:
    """Pairs of classes in different components that pass the filters."""
    of = postings.join(member, postings.c == member.node, "left").select(*postings.columns, F.coalesce("root", "c").alias("comp"))
    mixed = of.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    of = of.join(mixed, "token")
    left, right = (of.select(*[F.col(c).alias(f"{c}_{side}") for c in of.columns]) for side in "ab")
    a, b = (lambda x: F.col(f"{x}_a")), (lambda x: F.col(f"{x}_b"))
    need = F.expr(f"({bounds.num} * (n_a + n_b) + {bounds.num + bounds.den - 1}) div {bounds.num + bounds.den}")
    indexed = F.expr(f"pos_a < n_a - (2 * {bounds.num} * n_a + {bounds.num + bounds.den - 1}) div {bounds.num + bounds.den} + 1")
    apart = sum((F.bit_count(a(f"b{k}").bitwiseXOR(b(f"b{k}"))) for k in range(1, 4)), F.bit_count(a("b0").bitwiseXOR(b("b0"))))
    smaller = (a("n") < b("n")) | ((a("n") == b("n")) & (a("c") < b("c")))
    on = (
        (a("token") == b("token")) & (a("comp") != b("comp")) & smaller & indexed & (bounds.den * a("n") >= bounds.num * b("n"))
        & (F.least(a("n") - a("pos"), b("n") - b("pos")) >= need) & (apart <= a("n") + b("n") - 2 * need)
    )
    return left.join(right, on).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()


def similar(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, lower: bool = True, keyed: bool = False) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two rows link when den * |I| >= num * |U| of their sets of n-word shingles, (num, den) being the threshold. A row
    with fewer words has one shingle, of them all; one without words or text has none and links with nothing.
    Equal rows link. A row with a null id links like any other and names a component only if none has an id. Other columns
    are left out; an empty table gives an empty table. ``keyed`` adds text_key, a 64-bit hash of the text.
    """
    bounds = Bounds(*threshold)
    docs = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a row is known by its id and text, as 96 bits of hashes; repeated rows share them
    keys = docs.select("id", F.xxhash64("text").alias("key"), F.hash("text").alias("key2"), "text")
    own = F.xxhash64("id", "key", "key2").alias("own")
    scan = written(keys.mapInArrow(_scanned(n, lower), _SCAN), "sets")
    rows = scan.where("part IS NULL").select("id", "key", own, "key2", "n", "fp", "c", "b0", "b1", "b2", "b3")
    sketch = _sketch(scan)
    bitmap = [f"b{k}" for k in range(4)]
    classes = rows.where("fp IS NOT NULL").groupBy("fp", "c").agg(F.min("id").alias("least"), F.min(F.struct("own", "key2")).alias("body"), F.count(F.lit(1)).alias("copies"), *[F.first(b).alias(b) for b in bitmap])
    # by the number of texts: few tasks and files where they are few
    n_texts = scan.count()
    classes = written(classes.coalesce(max(1, n_texts // TASK_CLASSES)), "classes")
    posting = docs.select("text").mapInArrow(_postings(n, lower, bounds, sketch), "token long, c long, w long, hot long")
    met = posting.repartition("token", "hot").sortWithinPartitions("token", "hot", "c").mapInArrow(_met, "token long, c long, n long, pos long, hot long")
    met = written(met.join(classes.select("c", *bitmap), "c").select("token", "c", "n", "pos", "hot", *bitmap), "postings")
    # the text of one row of each class that met another; what repeats a row is dropped where the join has put it
    wanted = written(met.select("c").distinct().join(classes.select("c", "body.own", "body.key2"), "c").coalesce(max(1, n_texts // TASK_CLASSES)), "wanted")
    zipped = keys.select(own, "key2", "text").mapInArrow(_zipped, "own long, key2 int, blob binary")
    bodies = zipped.join(wanted, ["own", "key2"]).dropDuplicates(["own", "key2"]).select("c", "blob")
    bodies = written(bodies.coalesce(max(1, n_texts // TASK_BODIES)), "bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")  # its size decides whether it or the texts move
        a, b = (bodies.select(F.col("c").alias(f"c_{x}"), F.col("blob").alias(f"blob_{x}")) for x in "ab")
        both = pairs.join(a, F.col("a") == F.col("c_a")).join(b, F.col("b") == F.col("c_b")).select("a", "b", "blob_a", "blob_b")
        return written(both.mapInArrow(_verified(n, lower, bounds), "a long, b long, linked boolean"), "verified")

    grouped = met.repartition("token", "hot").sortWithinPartitions("token", "n", "c")
    first = verified(grouped.mapInArrow(_likely(bounds), "a long, b long").distinct())
    member = components(first.where("linked").select("a", "b"))
    second = _crossing(met.drop("hot"), member, bounds).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = verified(second)
    links = second.where("linked").select("a", "b").unionByName(member.select(F.col("node").alias("a"), F.col("root").alias("b")))
    member = components(links)
    name = member.join(classes.select("c", "least"), F.col("node") == F.col("c")).groupBy("root").agg(F.min("least").alias("component"))
    of = member.join(name, "root").select("node", "component")
    named = classes.join(of, F.col("c") == F.col("node"), "left").where("copies > 1 OR component IS NOT NULL").select(F.col("fp").alias("__fp"), F.coalesce("component", "least").alias("component"))
    out = rows.select("id", "key", "n", "fp").join(named, F.col("fp") == F.col("__fp"), "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), *([F.col("key").alias("text_key")] if keyed else []))


def without_copies(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that stay when one of each component does, the one of smallest id.

    Rows without words stay, as do those of components without any id; rows that repeat an id and a text count once.
    """
    found = similar(df, id, text, n, threshold, keyed=True)
    stay = found.where(F.col(id).eqNullSafe(F.col("component_id"))).select(F.col(id).alias("__id"), F.col("text_key").alias("__key")).distinct()
    own = df.withColumn("__own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = own.join(stay, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_semi")
    return kept.dropDuplicates([id, "__own"]).drop("__own")
