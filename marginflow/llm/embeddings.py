"""Near-duplicate vectors by int8 tile products with error bounds, full precision where it can matter.

A unit vector u is stored as s * q with q of int8, and its error e = |u - s q| is kept. For two vectors
|u.v - s_u s_v q_u.q_v| <= (1 + e_u) e_v + e_u, so a pair whose product falls short of the threshold by more than
that is no link; the others are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import with_code
from .common import checkpointed, components

THRESHOLD = 0.9
#: Vectors of a block. A tile compares two blocks.
BLOCK_ROWS = 8192
#: Rounding of double-precision products of unit vectors, far above what it can be.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the norm of what each row lost."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1) + SLACK


def candidates(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of pairs that can reach the threshold, and whether they surely do, between x and y, or
    i < j within x. A side is (q, scale, error).

    They come in parts of about a million products, ordered by i, so that a dense block needs no more memory.
    """
    (qx, sx, ex), (qy, sy, ey) = x, x if y is None else y
    # products of int8 are whole numbers below 2^24, exact in single precision up to 1040 components, which has the
    # fast matrix product; else double
    kind = np.float32 if qx.shape[1] * 127 * 127 < 1 << 24 else np.float64
    fx, fy = qx.astype(kind), qy.astype(kind).T.copy()
    # s_u s_v q.q >= threshold - (1 + e_u) e_v - e_u, the right side as low as any v of the block has it
    most_e, most_s = ey.max(), sy.max()
    step = max(1, (1 << 20) // max(1, len(qy)))
    for at in range(0, len(qx), step):
        products = fx[at : at + step] @ fy
        part = slice(at, at + step)
        floor = (threshold - (1 + ex[part]) * most_e - ex[part] - SLACK) / sx[part]
        # divided by the scale that makes it least, which depends on its sign
        floor = np.where(floor > 0, floor / most_s, floor / sy.min()) - 1
        i, j = np.nonzero(products >= floor[:, None].astype(kind))
        about = products[i, j] * sx[at + i] * sy[j]
        bound = (1 + ex[at + i]) * ey[j] + ex[at + i] + SLACK
        ok = about + bound >= threshold
        if y is None:
            ok &= at + i < j
        if ok.any():
            yield at + i[ok], j[ok], (about - bound >= threshold)[ok]


def cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision."""
    return np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))


class Spanning:
    """Keeps fewer links than rows, which connect what all links given connect."""

    def __init__(self, n: int):
        self.label, self.kept = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links (i, j), ordered by i."""
        cuts = np.flatnonzero(np.diff(i)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(i)], strict=True):
            if lo == hi:
                continue
            others, first = np.unique(self.label[j[lo:hi]], return_index=True)
            mine = self.label[i[lo]]
            new = others != mine
            if new.any():
                self.kept += [(int(i[lo]), int(k)) for k in j[lo:hi][first[new]]]
                self.label[np.isin(self.label, others[new])] = mine


class Found:
    """Link counts and spanning links of a tile's rows, as rows (a, b, n)."""

    def __init__(self, ids: np.ndarray, times: np.ndarray):
        self.ids, self.times = ids, times
        self.counts, self.tree = np.zeros(len(ids), np.int64), Spanning(len(ids))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.counts, i, self.times[j])
        np.add.at(self.counts, j, self.times[i])
        self.tree.add(i, j)

    def columns(self) -> tuple[list[int], list[int | None], list[int]]:
        hit, span = np.flatnonzero(self.counts), self.tree.kept
        a = self.ids[hit].tolist() + [int(self.ids[x]) for x, _ in span]
        return a, [None] * len(hit) + [int(self.ids[y]) for _, y in span], self.counts[hit].tolist() + [0] * len(span)


def _side(table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(table.num_rows, -1)
    return q[rows], table.column("s").to_numpy()[rows], table.column("e").to_numpy()[rows]


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= threshold; component_id is the least id reachable. A vector that
    is null, empty, zero or holds a null or non-finite component links with nothing and is its own component.
    Vectors of different length never link. Equal vectors are compared once and count as often as they occur, so a
    repeated row links with its copies. The threshold has to be positive. No pairs leave a tile: it gives link
    counts and links that span its components. The distinct vectors' blocks are compared all with all, which the
    exact result needs: nothing smaller bounds the cosine of vectors that point anywhere.

    Only int8 vectors, with scale and error, are copied to the tiles. Pairs that the bounds decide are done with; of
    the others a tile names the vectors, and these alone are sent to it in full precision.
    """
    if threshold <= 0:
        raise ValueError("the threshold has to be positive")
    values = F.col(embedding).cast("array<double>")
    fine = F.coalesce(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0), F.lit(False))
    # single precision stays so until it is in a tile: half the bytes to move
    kept = F.col(embedding) if vectors.schema[embedding].dataType.simpleString() == "array<float>" else values
    rows = vectors.select(F.col(vec_id).alias("id"), F.when(fine, kept).alias("v"))
    distinct = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    distinct = checkpointed(distinct.select(F.xxhash64("v", F.lit(2)).alias("vh"), "id", "times", "v"))
    blocks = max(1, -(-distinct.count() // block_rows))

    def full(table) -> np.ndarray:
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).astype(float)
        # the largest component scales to 1, so that neither squares overflow nor all of them vanish
        return v / np.abs(v).max(1)[:, None]

    def quantised(batches):
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.diff(table.column("v").combine_chunks().offsets.to_numpy())
            for dim in np.unique(sizes):
                part = table.take(pa.array(np.flatnonzero(sizes == dim)))
                x = full(part)
                q, scale, error = quantise(x / np.linalg.norm(x, axis=1)[:, None])
                made = [pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(error)]
                yield pa.RecordBatch.from_arrays([part.column("vh").combine_chunks(), part.column("times").combine_chunks(), pa.array(np.full(len(q), dim, np.int32)), *made], names=["vh", "times", "dim", "q", "s", "e"])

    small = with_code(distinct).select("vh", "times", "v").mapInArrow(quantised, "vh long, times long, dim int, q binary, s double, e double")
    # written once: the second look has to see the same numbers
    small = checkpointed(small.withColumn("k", F.pmod("vh", F.lit(blocks)).cast("int")))
    dealt = small.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("dim", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), "k", "vh", "times", "q", "s", "e")

    def pairs(key, table):
        _, lo, hi = (k.as_py() for k in key)
        side = table.column("k").to_numpy()
        a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        if len(a) and len(b):
            for i, j, sure in candidates(_side(table, a), _side(table, b) if lo != hi else None, threshold):
                yield a[i], b[j], sure

    def tile(key, table):
        import pyarrow as pa

        ids = table.column("vh").to_numpy()
        found, open_ = Found(ids, table.column("times").to_numpy()), np.zeros(len(ids), bool)
        for i, j, sure in pairs(key, table):
            found.add(i[sure], j[sure])
            open_[i[~sure]] = open_[j[~sure]] = True
        a, b, n = found.columns()
        left = ids[open_].tolist()
        dim, lo, hi = (k.as_py() for k in key)
        place = lambda x, kind: pa.array([None] * len(a) + [x] * len(left), kind)
        return pa.table({"a": pa.array(a + left, pa.int64()), "b": pa.array(b + [None] * len(left), pa.int64()), "n": pa.array(n + [None] * len(left), pa.int64()), "dim": place(dim, pa.int32()), "lo": place(lo, pa.int32()), "hi": place(hi, pa.int32())})

    first = checkpointed(with_code(dealt).groupBy("dim", "lo", "hi").applyInArrow(tile, "a long, b long, n long, dim int, lo int, hi int"))
    undecided = first.where("n IS NULL").select(F.col("a").alias("vh"), "lo", "hi")
    again = undecided.join(small, "vh").join(distinct.select("vh", "v"), "vh").select("dim", "lo", "hi", "k", "vh", "times", "q", "s", "e", "v")

    def judged(key, table):
        import pyarrow as pa

        v, found = full(table), Found(table.column("vh").to_numpy(), table.column("times").to_numpy())
        for i, j, sure in pairs(key, table):
            i, j = i[~sure], j[~sure]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                near = cosines(v[x], v[y]) >= threshold
                found.add(x[near], y[near])
        a, b, n = found.columns()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    second = with_code(again).groupBy("dim", "lo", "hi").applyInArrow(judged, "a long, b long, n long")
    found = checkpointed(first.where("n IS NOT NULL").select("a", "b", "n").unionByName(second))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("vh")).agg(F.sum("n").alias("n"))
    parts = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "vh")
    of = distinct.select("vh", "id", "times").join(parts, "vh", "left").join(counts, "vh", "left")
    of = checkpointed(of.select("vh", "id", "times", F.coalesce("component", "vh").alias("component"), F.coalesce("n", F.lit(0)).alias("n")))
    # minima are written before they are joined, so that the join can split a component with most of the vectors
    least = checkpointed(of.groupBy("component").agg(F.min("id").alias("least")))
    of = of.join(least, "component").select("vh", "least", (F.col("n") + F.col("times") - 1).alias("n"))
    all_rows = rows.withColumn("vh", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(2)))).select("id", "vh")
    joined = all_rows.join(of, "vh", "left")
    component = F.coalesce("least", "id")
    return joined.select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
