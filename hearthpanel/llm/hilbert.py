"""Approximate nearest neighbours from several Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.llm.common import store

#: Vectors that fit the projections, chosen by a hash of their id.
SAMPLE = 20_000
CURVES = 8
#: Principal directions that each curve turns at random, and dimensions of the curve.
DIRECTIONS = 16
DIMENSIONS = 8
BITS = 7
#: A query looks so far along each curve in both directions: a share of all vectors, and so many at least.
REACH = 0.1
LEAST = 512
#: Neighbouring vectors of a curve that a task compares with queries at a time.
BLOCK = 4096


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with unsigned integer coordinates below 2**bits (Skilling's transform)."""
    axes = [c.astype(np.uint64) for c in points.T]
    for level in range(bits - 1, 0, -1):
        high, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i, axis in enumerate(axes):
            inverted = (axis & high) != 0
            swap = np.where(inverted, np.uint64(0), (axes[0] ^ axis) & below)
            axes[0] = np.where(inverted, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flips = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flips = np.where((axes[-1] >> np.uint64(level)) & np.uint64(1), flips ^ np.uint64((1 << level) - 1), flips)
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ flips) >> np.uint64(bit)) & np.uint64(1))
    return key


class Curves:
    """Shifted curves over random turns of the principal directions of a sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 11):
        width = sample.shape[1]
        random = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        _, directions = np.linalg.eigh(np.cov((sample - self.mean).T).reshape(width, width) if len(sample) > 1 else np.eye(width))
        directions = directions[:, ::-1][:, : min(width, DIRECTIONS)]
        self.dimensions = min(directions.shape[1], DIMENSIONS)
        self.turns, self.low, self.step = [], [], []
        for _ in range(curves):
            turn = np.linalg.qr(random.normal(size=(directions.shape[1],) * 2))[0][:, : self.dimensions]
            turn = directions @ turn
            placed = (sample - self.mean) @ turn
            low, high = placed.min(0), placed.max(0)
            side = np.maximum(high - low, 1e-9) * 2
            self.turns.append(turn)
            self.low.append(low - random.uniform(0, 0.5, self.dimensions) * side)
            self.step.append(side / (1 << BITS))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Keys of the vectors on every curve; those outside of the sample's box go to its border."""
        return [
            hilbert(np.clip((((vectors - self.mean) @ t) - a) / s, 0, (1 << BITS) - 1), BITS).astype(np.int64)
            for t, a, s in zip(self.turns, self.low, self.step)
        ]


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(block: list[tuple], queries: list[tuple], reach: int, k: int) -> list[tuple[int, int, float]]:
    """(query, vector, distance) of the k nearest block members within reach of each query on the curve, ties to smaller ids."""
    ranks, ids = np.array([b[0] for b in block]), np.array([b[1] for b in block])
    vectors = np.array([b[2] for b in block], float)
    squares = (vectors**2).sum(1)
    out = []
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        at, own = np.array([q[0] for q in part])[:, None], np.array([q[1] for q in part])[:, None]
        wanted = np.array([q[2] for q in part], float)
        rough = squares - 2 * (wanted @ vectors.T)
        rough[(np.abs(ranks - at) > reach) | (ids == own)] = np.inf
        # All that may be as near as the k-th: rough distances are off by rounding only.
        last = np.partition(rough, min(len(ids), k) - 1, axis=1)[:, min(len(ids), k) - 1]
        size = squares.max() + (wanted**2).sum(1)
        last += 16 * (vectors.shape[1] + 4) * np.finfo(float).eps * size
        for i, query in enumerate(part):
            near = np.flatnonzero(np.isfinite(rough[i]) & (rough[i] <= last[i]))
            distance = np.sqrt(((vectors[near] - wanted[i]) ** 2).sum(1))
            best = np.lexsort((ids[near], distance))[:k]
            out += [(query[1], int(v), float(d)) for v, d in zip(ids[near][best], distance[best])]
    return out


def neighbours(vectors: DataFrame, queries: Column, *, k: int = 10, reach: float = REACH, curves: int = CURVES) -> DataFrame:
    """The k nearest rows found for every row of (vec_id, embedding) that ``queries`` selects: query_id, rank, vec_id, score.

    Of equal vectors only the k + 1 with the smallest ids can be found, so only
    these are candidates; a query beyond them looks from the place of the first.
    Every candidate is placed on several Hilbert curves, which differ by a turn of
    the principal directions and a shift. Each ordering is range-partitioned
    and numbered; its rows are cut into blocks of neighbours, and a query goes
    to the blocks that its window reaches on each curve. Blocks return their
    nearest by exact Euclidean distance, and these are merged per query.

    ``reach`` is the share of all vectors on each side; recall and cost rise
    with it. Vectors that are null, zero or hold a null or non-finite component
    take no part, nor do those with a null id. Vectors of each length have curves
    of their own and are searched among themselves. Rows that repeat an id count as one, with the
    smallest vector. Fewer than k candidates give fewer rows; empty tables none.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = store(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "hilbert-vectors")
    totals = {r.width: r.n for r in rows.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()}
    placed, first_curve = {}, {}
    for width in sorted(totals):
        sample = rows.filter(F.size("embedding") == width).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
        first_curve[width] = len(placed) * curves
        placed[width] = Curves(np.array(sample.embedding.tolist(), float), curves)
    equal = Window.partitionBy("embedding").orderBy("vec_id")
    held = store(rows.withColumn("copy", F.row_number().over(equal)).filter(F.col("copy") <= k + 1), "hilbert-candidates")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                widths = batch.column("embedding").value_lengths().to_numpy()
                for width in np.unique(widths).tolist():
                    part = batch.take(pa.array(np.flatnonzero(widths == width)))
                    points = np.array(part.column("embedding").to_pylist(), float)
                    for curve, key in enumerate(placed[width].keys(points), first_curve[width]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), curve), pa.int32()), pa.array(key), part.column("vec_id")], ["curve", "key", "vec_id"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            at = []
            for curve in batch.column("curve").to_pylist():
                at.append(seen.get(curve, 0))
                seen[curve] = at[-1] + 1
            yield pa.RecordBatch.from_arrays([batch.column("curve"), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), batch.column("vec_id")], ["curve", "part", "at", "vec_id"])

    ordered = held.select("vec_id", "embedding").mapInArrow(keys, "curve int, key long, vec_id long").repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    ordered = store(ordered.mapInArrow(number, "curve int, part int, at long, vec_id long"), "hilbert-order")
    counts = ordered.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    reaches = {width: max(LEAST, int(np.ceil(reach * n))) for width, n in totals.items()}
    ends = counts.groupBy("curve").agg(F.floor((F.sum("n") - 1) / BLOCK).cast("int").alias("last"))
    placed_ids = ordered.join(bases, ["curve", "part"]).select("curve", (F.col("base") + F.col("at")).alias("place"), "vec_id")
    ranked = placed_ids.join(held.drop("copy"), "vec_id")
    beyond = rows.filter(queries).join(held.select("vec_id"), "vec_id", "left_anti")
    firsts = held.filter("copy = 1").select(F.col("vec_id").alias("first"), "embedding")
    beyond = beyond.join(firsts, "embedding").join(placed_ids.withColumnRenamed("vec_id", "first"), "first").select("curve", "place", "vec_id", "embedding")
    members = ranked.withColumns({"block": F.floor(F.col("place") / BLOCK).cast("int"), "query": F.lit(False)})
    far = F.lit(0)
    for width, n in reaches.items():
        far = F.when(F.size("embedding") == width, n).otherwise(far)
    reached = F.sequence(F.greatest(F.floor((F.col("place") - far) / BLOCK), F.lit(0)).cast("int"), F.least(F.floor((F.col("place") + far) / BLOCK), F.col("last")).cast("int"))
    asked = ranked.filter(queries).unionByName(beyond).join(ends, "curve")
    asked = asked.withColumns({"block": F.explode(reached), "query": F.lit(True)}).drop("last")
    met = members.unionByName(asked).repartition("curve", "block").sortWithinPartitions("curve", "block", "query", "vec_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["curve", "block", "query", "place", "vec_id", "embedding"]
        cells = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names)))
        for _, group in groupby(cells, key=itemgetter(0, 1)):
            block: list[tuple] = []
            waiting: list[tuple] = []
            for _, _, query, *row in group:
                (waiting if query else block).append(row)
                if len(waiting) == 4096:
                    yield as_batch(nearest(block, waiting, reaches[len(waiting[0][2])], k))
                    waiting = []
            if waiting:
                yield as_batch(nearest(block, waiting, reaches[len(waiting[0][2])], k))

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(compare, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
