"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors whose cosine is at least c are at most ``2 - 2c`` apart in squared distance, and a rotation changes no
distance. Cut the rotated vectors into blocks: in at least one block the two are closer than the block's share of that
budget, in proportion to its dimensions. A range join in every block therefore finds all of them, and the exact cosine
decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import partitions, pick, staged
from panelweave.llm.links import components

#: Blocks that the rotated vectors are cut into.
BLOCKS = 4
#: Vectors in one strip of a block, at about; a task compares two strips.
STRIP = 4_096
#: What rounding may add to a squared distance of single precision coordinates.
SLACK = 1e-5


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random rotation, the same for all tasks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, blocks: int = BLOCKS,
                 strip: int = STRIP) -> DataFrame:
    """Vectors linked by a cosine of at least ``cosine``, which must be positive.

    Returns one row per input row: the id, ``n_links`` (rows linked with this one, itself left out), ``component_id``
    (the smallest id that links reach) and ``kept`` (that is its own id). Ids are whole numbers and not repeated;
    a null id links with nothing and has no component. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing; so do vectors of different lengths. Equal vectors are one class, of which
    the smallest id stands for all, so copies are counted without forming their pairs.

    In a block, classes are cut into strips along the block's first axis, and strips no further apart than the
    block's share of the budget meet, each pair of strips in a task of its own with just the block's coordinates.
    Strips that hold more than they should are cut again by a hash, so a dense region is many tasks.
    """
    rows = pick(vectors, id=vectors[id_col].cast("bigint"), vector=vector_col)
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    doubles = rows.where(whole).select("id", F.col("vector").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("vector", lambda x: x == 0)
    doubles = doubles.where(~F.coalesce(bad, F.lit(True))).where(~zero)
    grouped = staged(doubles.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).groupBy("vector").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("size")))
    members = doubles.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).join(grouped, "vector").select("id", "class", "size")
    links = None
    for dims in sorted(r[0] for r in grouped.select(F.size("vector")).distinct().collect()):
        own = grouped.where(F.size("vector") == dims)
        found = _verified(_candidates(own, dims, cosine, min(blocks, dims), strip), own, cosine)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = grouped.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)
    links = staged(links)

    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = grouped.select(F.col("class").alias("b"), "size")
    counted = ends.join(sizes, "b").groupBy(F.col("a").alias("class")).agg(F.sum("size").alias("others"))
    reached = components(links)
    out = members.join(counted, "class", "left").join(reached, F.col("class") == F.col("node"), "left")
    out = out.select("id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    lone = rows.select("id").join(out.select("id"), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(lone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _candidates(classes: DataFrame, dims: int, cosine: float, blocks: int, strip: int) -> DataFrame:
    """Distinct pairs (a, b) of classes, a < b, that some block cannot tell apart."""
    spark = classes.sparkSession
    cuts = [dims * k // blocks for k in range(blocks + 1)]
    budgets = [(2 - 2 * cosine) * (hi - lo) / dims + SLACK for lo, hi in zip(cuts, cuts[1:])]
    turn = rotation(dims)

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.asarray(batch.column(1).flatten()).reshape(len(batch), dims)
            x = x / np.abs(x).max(1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn
            ids = np.tile(np.asarray(batch.column(0)), blocks)
            own = [x[:, lo:hi].astype(np.float32) for lo, hi in zip(cuts, cuts[1:])]
            data = pa.array([row.tobytes() for part in own for row in part], pa.binary())
            first = np.concatenate([part[:, 0] for part in own]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(blocks, dtype=np.int32), len(batch))), pa.array(ids), pa.array(first), data],
                                             names=["block", "id", "first", "data"])

    parts = staged(classes.select("class", "vector").mapInArrow(rotated, "block int, id bigint, first double, data binary"))
    total = classes.count()
    strips = max(1, -(-total // strip))
    edges = {}
    if strips > 1:
        probabilities = [k / strips for k in range(1, strips)]
        for r in parts.groupBy("block").agg(F.percentile_approx("first", probabilities, 20 * strips).alias("edges")).collect():
            edges[r["block"]] = sorted(set(r["edges"]))
    at = F.lit(0)
    for block, values in edges.items():
        inside = F.size(F.filter(F.array(*[F.lit(float(v)) for v in values]), lambda e: e <= F.col("first")))
        at = F.when(F.col("block") == block, inside).otherwise(at)
    placed = parts.withColumn("strip", at)
    measured = {(r["block"], r["strip"]): r for r in placed.groupBy("block", "strip").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("low"), F.max("first").alias("high")).collect()}
    # Cells: strips, cut by a hash where they hold more than twice what they should. Their number follows the rows'.
    cells = [(b, s, h, -(-r["n"] // (2 * strip))) for (b, s), r in sorted(measured.items()) for h in range(-(-r["n"] // (2 * strip)))]
    number = {c[:3]: i for i, c in enumerate(cells)}
    meets: dict[int, list[int]] = {}
    for b, s, h, _ in cells:
        i = number[b, s, h]
        for b2, s2, h2, _ in cells:
            j = number[b2, s2, h2]
            if b2 == b and j >= i and measured[b, s2]["low"] - measured[b, s]["high"] <= budgets[b] ** 0.5 + SLACK:
                meets.setdefault(i, []).append(i * len(cells) + j)
                if j != i:
                    meets.setdefault(j, []).append(i * len(cells) + j)
    kinds = spark.createDataFrame([(b, s, h, n, number[b, s, h], meets[number[b, s, h]]) for b, s, h, n in cells],
                                  "block int, strip int, piece int, pieces int, cell int, tiles array<bigint>") if cells else None
    if kinds is None:
        return classes.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)
    pieces = kinds.select("block", "strip", "pieces").distinct()
    placed = placed.join(pieces, ["block", "strip"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    dealt = placed.join(kinds.drop("pieces"), ["block", "strip", "piece"]).select("block", "cell", "id", "data", F.explode("tiles").alias("tile"))
    width = len(cells)

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        tile, block = key[0].as_py(), rows.column("block")[0].as_py()
        ids, cell = np.asarray(rows.column("id")), np.asarray(rows.column("cell"))
        x = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.float32).reshape(len(ids), -1)
        left, right = cell == tile // width, cell == tile % width
        lid, rid, lx, rx = ids[left], ids[right], x[left], x[right]
        # x.y - |x|^2 / 2 - |y|^2 / 2 is minus half the squared distance: one product gives all of them.
        half = lambda v: (v * v).sum(1, dtype=np.float32)[:, None] / -2
        lx, rx = np.hstack([lx, half(lx), np.ones((len(lx), 1), np.float32)]), np.hstack([rx, np.ones((len(rx), 1), np.float32), half(rx)])
        least = np.float32(-(budgets[block] + SLACK) / 2)
        a, b = [], []
        for lo in range(0, len(lid), 512):
            near = np.flatnonzero(lx[lo:lo + 512] @ rx.T >= least)
            a.append(lid[lo + near // len(rid)] if len(rid) else lid[:0])
            b.append(rid[near % len(rid)] if len(rid) else rid[:0])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        keep = a < b if tile // width == tile % width else a != b
        a, b = a[keep], b[keep]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    tiles = len({t for m in meets.values() for t in m})
    return dealt.repartition(max(partitions(spark), min(tiles, 10_000)), "tile").groupBy("tile").applyInArrow(compare, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine, in double precision, is as high as asked."""
    a, b = (classes.select(F.col("class").alias(side), F.col("vector").alias(f"vector_{side}")) for side in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.asarray(batch.column(k).flatten()).reshape(len(batch), -1) for k in (2, 3))
                x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))  # no square leaves the range of doubles
                close = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield batch.select([0, 1]).filter(pa.array(close >= cosine))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "vector_a", "vector_b").mapInArrow(run, "a bigint, b bigint")
