"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors are put in the lexicographic order of 64 concatenated random sign hashes and
compared, exactly, with a bounded window of neighbours in that order; verified pairs of all passes are
united. The number of passes follows from the number of vectors, so that among evenly spread ones a pair at the threshold
is met in one of them with the asked probability. How crowded the order is around each vector is measured in each pass;
vectors whose chance of meeting a partner remains lower, as in a dense region, are compared with each other exactly, block
by block. Equal vectors are one class throughout, with its size. Inside a component the links are then counted block by
block, so a group wider than the window loses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm._scratch import written
from tidegate.llm.components import components

THRESHOLD, RECALL, WINDOW, BLOCK, LEAST_PASSES = 0.95, 0.99, 256, 512, 6
#: Crowded vectors in a block.
CROWD_ROWS = 2048
#: Vectors, times passes, that one task orders.
TASK_ROWS = 1 << 16


def _agree(aim: float) -> float:
    """Chance that two vectors at that cosine agree in a bit."""
    return 1 - math.acos(max(-1.0, min(1.0, aim))) / math.pi


def passes_for(n: int, window: int, aim: float = THRESHOLD, recall: float = RECALL) -> int:
    """A pair is met in a pass if it agrees in as many leading bits as tell a window of n vectors apart; two bits more
    leave room for uneven places, so that few vectors count as crowded."""
    bits = max(1.0, math.log2(max(2, n) / window)) + 2
    met = min(_agree(aim) ** bits, 1 - 1e-9)
    return max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _bits_needed(key: np.ndarray, window: int) -> np.ndarray:
    """Leading bits in which a partner of each of the sorted keys has to agree to stand within the window.

    Those too near to an end of the part take the value of the nearest that isn't.
    """
    bits = (key.view(np.uint64) ^ np.uint64(1 << 63)).copy()

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d, n = x ^ y, np.zeros(len(x), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            n = np.where((d >> (np.uint64(64) - (n + step).astype(np.uint64))) == 0, n + step, n)
        return n

    if len(bits) <= 2 * window:
        return np.full(len(bits), 1 + shared(bits[:1], bits[-1:])[0] if len(bits) > window else 0)
    far = shared(bits[window:], bits[:-window])
    inner = 1 + np.maximum(far[:-window], far[window:])
    return np.concatenate([np.full(window, inner[0]), inner, np.full(window, inner[-1])])


def _matrix(cells: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as bytes of doubles; null for the others."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            a = None if v is None or not v or any(c is None for c in v) else np.asarray(v, np.float64)
            out.append(None if a is None or not np.isfinite(a).all() or not a.any() else (a + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["__id", "v"])


def _keys(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            cid, cells = batch.column("cid").to_pylist(), batch.column("v").to_pylist()
            for size in {len(c) for c in cells}:
                at = [i for i, c in enumerate(cells) if len(c) == size]
                for lo in range(0, len(at), 4096):
                    some = at[lo : lo + 4096]
                    x = _matrix([cells[i] for i in some])
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, size]).standard_normal((x.shape[1], 64 * passes))
                    bits = (x @ planes[size] > 0).reshape(len(some), passes, 64)
                    key = np.packbits(bits, axis=2).view(">u8").reshape(len(some), passes).astype(np.uint64)
                    key = (key ^ np.uint64(1 << 63)).view(np.int64)  # keeps the order as signed numbers
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), p, np.int32)), pa.array(np.full(len(some), size, np.int32)), pa.array(key[:, p]), pa.array([cid[i] for i in some], pa.binary()), pa.array([cells[i] for i in some], pa.binary())],
                            names=["pass", "size", "key", "cid", "v"],
                        )

    return run


def _joined(near: np.ndarray) -> np.ndarray:
    """Smallest index connected to each, for a symmetric matrix of links."""
    label = np.arange(len(near))
    linked = np.flatnonzero(near.sum(1) > 1)
    while True:
        new = label.copy()
        for i in linked:
            new[i] = label[near[i]].min()
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Window:
    """The last rows seen in order, of one pass and size."""

    def __init__(self, threshold: float, window: int):
        self.threshold, self.window, self.of, self.cid, self.x = threshold, window, None, [], None

    def add(self, of, cid: list[bytes], cells: list[bytes]) -> list[tuple[bytes, bytes]]:
        x, before = _matrix(cells), 0
        if of == self.of:
            before, cid, x = len(self.cid), self.cid + cid, np.concatenate([self.x, x])
        near = x @ x.T >= self.threshold
        near[np.arange(len(x)), np.arange(len(x))] = True
        if before:
            near[:before, :before] = np.eye(before, dtype=bool)  # compared already
        label = _joined(near)
        self.of, self.cid, self.x = of, cid[-self.window :], x[-self.window :]
        return [(cid[i], cid[k]) for i, k in enumerate(label) if i != k]


_FOUND = "a binary, b binary, edge int, at int, pass int, size int, key long, cid binary, v binary, credit double"


def _windows(threshold: float, window: int):
    """Links within a partition, its first and last rows for the boundaries to its neighbours, and for each row the
    credit of the pass: minus the logarithm of the chance that a partner at the threshold isn't met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, me, seen, last = _Window(threshold, window), TaskContext.get().partitionId(), 0, []
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("edge", pa.int32()), ("at", pa.int32()), ("pass", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("cid", pa.binary()), ("v", pa.binary()), ("credit", pa.float64())])
        of, keys, cids = [], [], []
        blank = dict.fromkeys(schema.names)
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for lo, hi in _runs([(r["pass"], r["size"]) for r in rows], BLOCK):
                part = rows[lo:hi]
                out += [blank | {"a": a, "b": b} for a, b in w.add((part[0]["pass"], part[0]["size"]), [r["cid"] for r in part], [r["v"] for r in part])]
            if seen < window:
                out += [r | {"a": None, "b": None, "edge": me - 1, "at": 1} for r in rows[: window - seen]]
            of += [(r["pass"], r["size"]) for r in rows]
            keys += [r["key"] for r in rows]
            cids += [r["cid"] for r in rows]
            seen += len(rows)
            last = (last + rows)[-window:]
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist([r | {"a": None, "b": None, "edge": me, "at": 0} for r in last], schema)
        for lo, hi in _runs(of, len(of)):
            met = np.minimum(_agree(threshold) ** _bits_needed(np.array(keys[lo:hi], np.int64), window), 1 - 1e-9)
            cols = {"cid": pa.array(cids[lo:hi], pa.binary()), "credit": pa.array(-np.log1p(-met))}
            yield pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(hi - lo, f.type)) for f in schema], schema=schema)

    return run


def _runs(of: list, most: int) -> Iterator[tuple[int, int]]:
    lo = 0
    for i in range(1, len(of) + 1):
        if i == len(of) or of[i] != of[lo] or i - lo == most:
            yield lo, i
            lo = i


def _across(threshold: float, window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["at"], r["pass"], r["size"], r["key"], r["cid"]))
        left, right = [r for r in rows if r["at"] == 0], [r for r in rows if r["at"] == 1]
        out = []
        if left and right:
            of = (right[0]["pass"], right[0]["size"])
            left, right = [r for r in left if (r["pass"], r["size"]) == of], [r for r in right if (r["pass"], r["size"]) == of]
            if left:
                near = _matrix([r["v"] for r in left]) @ _matrix([r["v"] for r in right]).T >= threshold
                for side, axis in ((near.argmax(1), 1), (near.argmax(0), 0)):  # one link for each row that has some joins all: rows of one side are compared
                    for i in np.flatnonzero(near.any(axis)):
                        out.append((left[i]["cid"], right[side[i]]["cid"]) if axis else (left[side[i]]["cid"], right[i]["cid"]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return run


def _crowd(threshold: float):
    """Links of two blocks of crowded vectors."""

    def run(table: pa.Table) -> pa.Table:
        cid, x = table.column("cid").to_pylist(), _matrix(table.column("v").to_pylist())
        near = np.eye(len(x), dtype=bool)
        for lo in range(0, len(x), BLOCK):
            near[lo : lo + BLOCK] |= x[lo : lo + BLOCK] @ x.T >= threshold
        near |= near.T
        out = [(cid[i], cid[k]) for i, k in enumerate(_joined(near)) if i != k]
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return run


def _counted(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        cid, n, side = table.column("cid").to_pylist(), table.column("n").to_numpy(), table.column("blk").to_numpy()
        x, i, j = _matrix(table.column("v").to_pylist()), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        near = x @ x.T >= threshold
        near[np.arange(len(x)), np.arange(len(x))] = False
        if i != j:
            near &= side[:, None] != side[None, :]
        return pa.table({"cid": pa.array(cid, pa.binary()), "links": pa.array(near @ n, pa.int64())})

    return run


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per row: id, n_links (other rows linked directly), component_id (smallest id reachable, itself
    included), kept (id = component_id).

    Null, empty and zero vectors and those with a null or non-finite component link with nothing; vectors of
    different lengths neither. Repeated rows are vectors of their own that link with each other. A row
    with a null id links like any other but gives no component its name, so it is kept only if its whole component
    has none. Other columns are left out; an empty table gives an empty table.
    """
    spark = df.sparkSession
    packed = df.select(F.col(id), F.col(vector)).mapInArrow(_packed, df.select(F.col(id).alias("__id")).schema.add("v", "binary"))
    rows = written(packed.withColumn("cid", F.unhex(F.sha2("v", 256))), "vectors")
    classes = written(rows.where("v is not null").groupBy("cid").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("__id").alias("least")), "classes")
    n = classes.count()
    passes = passes or passes_for(n, window, threshold)
    keyed = classes.select("cid", "v").mapInArrow(_keys(passes, seed), "pass int, size int, key long, cid binary, v binary")
    parts = max(1, math.ceil(n * passes / TASK_ROWS))
    parts = max(parts, min(12, math.ceil(n * passes / (8 * window))))
    ordered = keyed.repartitionByRange(parts, "pass", "size", "key", "cid").sortWithinPartitions("pass", "size", "key", "cid")
    found = written(ordered.mapInArrow(_windows(threshold, window), _FOUND), "windows")
    across = found.where("edge is not null").drop("a", "b", "credit").groupBy("edge").applyInArrow(_across(threshold, window), "a binary, b binary")
    links = found.where("a is not null").select("a", "b").unionByName(across)
    credit = found.where("credit is not null").groupBy("cid").agg(F.sum("credit").alias("credit"))
    crowded = written(classes.join(credit.where(F.col("credit") < -math.log(1 - RECALL)), "cid").select("cid", "v", F.length("v").alias("size")), "crowded")
    crowd_blocks = math.ceil(crowded.count() / CROWD_ROWS)
    if crowd_blocks:
        crowd = crowded.withColumn("blk", F.pmod(F.xxhash64("cid"), F.lit(crowd_blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(crowd_blocks - 1))))
        crowd = crowd.select("size", "cid", "v", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
        links = links.unionByName(crowd.groupBy("size", "i", "j").applyInArrow(_crowd(threshold), "a binary, b binary"))
    member = written(components(links), "members")
    size = member.groupBy("root").agg(F.count(F.lit(1)).alias("g"))
    joined = member.join(size, "root").join(classes, F.col("node") == F.col("cid")).withColumn("blocks", F.ceil(F.col("g") / block).cast("int"))
    joined = joined.withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = joined.select("root", "cid", "v", "n", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    counts = pairs.groupBy("root", "i", "j").applyInArrow(_counted(threshold), "cid binary, links long").groupBy("cid").agg(F.sum("links").alias("links"))
    name = member.join(classes.select("cid", "least"), F.col("node") == F.col("cid")).groupBy("root").agg(F.min("least").alias("component"))
    known = member.join(name, "root").join(counts, F.col("node") == F.col("cid")).select(F.col("node").alias("cid"), "component", "links")
    of = classes.join(known, "cid", "left").select(F.col("cid").alias("__cid"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("__links"), F.coalesce("component", "least").alias("__component"))
    out = rows.join(of.where((F.col("__links") > 0)), F.col("cid") == F.col("__cid"), "left")
    component = F.when(F.col("__links") > 0, F.col("__component")).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias(id), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))
