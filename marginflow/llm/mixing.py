"""Interleaves sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. In the ideal schedule all sources that last are served at once, each in
proportion to its exact weight; where one ends, the others share its part. Block k of a source is released at the
slot in which the ideal schedule begins it and due by the slot in which it ends it; in each slot the released block
with the earliest deadline goes next. The ideal schedule meets all these bounds, so earliest deadline first does
too: every prefix holds each source's share to within one block, however long it is and however many sources end.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import with_code
from .common import checkpointed, gapless_rank

BLOCK_ROWS = 8
#: Slots in which weights are rounded, where a caller asks for a repeated period.
PERIOD = 1000
#: Blocks of the streamed schedule written at a time.
CHUNK = 8192


def round_weights(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole numbers adding up to ``period`` in proportion to the weights, at least 1 each (largest remainders)."""
    total = sum(weights.values())
    share = {s: Fraction(w) * period / Fraction(total) for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in share.items()}
    order = sorted(share, key=lambda s: (out[s] - share[s], s))
    k = 0
    while sum(out.values()) != period:
        s = order[k % len(order)] if sum(out.values()) < period else max((s for s in out if out[s] > 1), key=lambda s: (out[s] - share[s], out[s], s))
        out[s] += 1 if sum(out.values()) < period else -1
        k += 1
    return out


def one_period(parts: dict[str, int], period: int | None = None) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks, ties by name."""
    period = period or sum(parts.values())
    waiting = [(0, -(-period // p), s, 0) for s, p in parts.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        due, s, k = heapq.heappop(ready)
        if due < slot + 1:
            raise AssertionError("a deadline was missed")
        out.append(s)
        k += 1
        p = parts[s]
        if k < p:
            heapq.heappush(waiting, (k * period // p, -(-(k + 1) * period // p), s, k))
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> list[dict]:
    """Phases: first block of each source, first slot, parts and one period's slots, until all blocks are placed.

    A phase ends when a source has no block left. At most as many phases as sources.
    """
    done, slot, out = dict.fromkeys(blocks, 0), 0, []
    while left := {s: blocks[s] - done[s] for s in blocks if blocks[s] > done[s]}:
        parts = round_weights({s: weights[s] for s in left}, max(period, len(left)))
        order = one_period(parts)
        size = len(order)
        places = {s: [i for i, x in enumerate(order) if x == s] for s in left}
        end = min((n - 1) // parts[s] * size + places[s][(n - 1) % parts[s]] + 1 for s, n in left.items())
        out.append({"first": {s: done[s] for s in left}, "slot": slot, "slots": end, "parts": parts, "places": places, "period": size})
        for s in left:
            done[s] += end // size * parts[s] + sum(p < end % size for p in places[s])
        slot += end
    return out


def streamed(rows: dict[str, int], weights: dict[str, float], block_rows: int = BLOCK_ROWS) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, phase, slot, first position) of each block in order of slots, by exact weights.

    A phase is a number of sources that have run out. Memory is bounded by the number of sources.
    """
    names = sorted(s for s in rows if rows[s])
    exact = [Fraction(weights[s]) for s in names]
    unit = lcm(*(w.denominator for w in exact))
    weight = [int(w * unit) for w in exact]
    blocks = [-(-rows[s] // block_rows) for s in names]
    # where sources end in the ideal schedule: blocks of those that ended, and the weight of those that last
    ends = sorted(range(len(names)), key=lambda i: Fraction(blocks[i], weight[i]))
    at = [blocks[i] / weight[i] for i in ends]
    ended, lasting = [0], [sum(weight)]
    for i in ends:
        ended.append(ended[-1] + blocks[i])
        lasting.append(lasting[-1] - weight[i])

    def window(i: int, k: int) -> tuple[int, int]:
        # both lines agree where a source ends, so the rounding of ``at`` is of no matter
        j, m = bisect_right(at, k / weight[i]), bisect_right(at, (k + 1) / weight[i])
        return ended[j] + k * lasting[j] // weight[i], ended[m] - (-(k + 1) * lasting[m] // weight[i])

    waiting = [(*window(i, 0), i, 0) for i in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    phase = start = 0
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, due, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, k))
        due, i, k = heapq.heappop(ready)
        if due < slot + 1:
            raise AssertionError("a deadline was missed")
        yield names[i], k, phase, slot, start
        start += min(block_rows, rows[names[i]] - k * block_rows)
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, (*window(i, k + 1), i, k + 1))
        else:
            phase += 1


def _written(counts: DataFrame, weights: dict[str, float] | None, block_rows: int) -> DataFrame:
    """The streamed schedule of the counted sources (__s, __n) as a table, simulated by one task chunk by chunk."""

    def run(batches):
        import pyarrow as pa

        rows = {s: n for batch in batches for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        given = {s: n**0.5 for s, n in rows.items() if s} if weights is None else weights
        least = min(given.values(), default=1.0)
        plan = streamed(rows, {s: given.get(s, least) for s in rows}, block_rows)
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        names = ["__s", "__block", "mix_phase", "mix_slot", "__start"]
        while chunk := [x for _, x in zip(range(CHUNK), plan)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk), kinds)], names=names)

    return checkpointed(with_code(counts.coalesce(1)).mapInArrow(run, "__s string, __block long, mix_phase int, mix_slot long, __start long"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", order: tuple[str, ...] = ("doc_id",), block_rows: int = BLOCK_ROWS, period: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with mix_phase, mix_slot (the block's place) and mix_position (the row's).

    Without ``weights`` each source weighs the square root of its rows, however many sources there are. A source
    without a weight, and null, share one remainder source with the least weight given; weights lie above 0. Rows of
    a source come in order of a hash of the row. Positions are 0, 1, 2, ... without gaps; all rows are kept; ties in
    ``order`` are broken by the whole row, so a task that is run again gives the same positions. Earlier columns of
    these names are replaced.

    The schedule is simulated by one task, which keeps the sources' counts in memory, and written as a table. With
    ``period``, weights are rounded to multiples of 1 / period instead and that one period is repeated in each
    phase: shares then hold to within a block of the rounded weights only, and the plan grows with the square of
    the number of sources.
    """
    if weights is not None and not all(w > 0 for w in weights.values()):
        raise ValueError("weights lie above 0")
    docs = docs.drop("mix_phase", "mix_slot", "mix_position")
    named = F.coalesce(F.col(source).cast("string"), F.lit(""))
    mapped = named if weights is None else F.when(named.isin(sorted(weights)), named).otherwise(F.lit("")) if weights else F.lit("")
    counts = docs.groupBy(mapped.alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = gapless_rank(docs.withColumns({"__s": mapped, "__h": F.xxhash64(*order, F.lit(8))}), ["__s"], ["__h", *order], "__rank")
    ranked = ranked.withColumn("__block", F.floor(F.col("__rank") / block_rows).cast("long"))
    if period is None:
        placed = ranked.join(_written(counts, weights, block_rows), ["__s", "__block"])
        return placed.select(*docs.columns, "mix_phase", "mix_slot", (F.col("__start") + F.col("__rank") % block_rows).alias("mix_position"))
    rows = {r[0]: r[1] for r in counts.collect()}
    if weights is None:
        weights = {s: n**0.5 for s, n in rows.items() if s}
    least = min(weights.values(), default=1.0)
    weight = {s: weights.get(s, least) for s in rows}
    phases = schedule({s: -(-n // block_rows) for s, n in rows.items()}, weight, period)
    # a last block can be short: later positions move up by what it lacks
    short = []
    table = []
    for k, p in enumerate(phases):
        for s, places in p["places"].items():
            stop = phases[k + 1]["first"].get(s) if k + 1 < len(phases) and s in phases[k + 1]["first"] else -(-rows[s] // block_rows)
            table.append((s, k, p["first"][s], stop, p["slot"], p["parts"][s], p["period"], places))
            if stop * block_rows > rows[s] and stop > p["first"][s]:
                b = stop - 1 - p["first"][s]
                at = p["slot"] + b // p["parts"][s] * p["period"] + places[b % p["parts"][s]]
                short.append((at, stop * block_rows - rows[s]))
    spark = docs.sparkSession
    # at most sources x phases rows, of a place for each of the period's slots
    plan = spark.createDataFrame(table, "__s string, mix_phase int, __first long, __stop long, __slot long, __parts long, __period long, __places array<long>").where("__first < __stop")
    placed = ranked.join(F.broadcast(plan), "__s").where("__block >= __first AND __block < __stop")
    k = F.col("__block") - F.col("__first")
    slot = F.col("__slot") + F.floor(k / F.col("__parts")).cast("long") * F.col("__period") + F.element_at("__places", (k % F.col("__parts") + 1).cast("int"))
    placed = placed.withColumn("mix_slot", slot)
    lacks = F.lit(0).cast("long")
    if short:
        lacking = F.array(*[F.struct(F.lit(a).cast("long").alias("at"), F.lit(n).cast("long").alias("n")) for a, n in sorted(short)])
        lacks = F.aggregate(lacking, F.lit(0).cast("long"), lambda total, x: F.when(x["at"] < F.col("mix_slot"), total + x["n"]).otherwise(total))
    position = F.col("mix_slot") * block_rows + F.col("__rank") % block_rows - lacks
    return placed.select(*docs.columns, "mix_phase", "mix_slot", position.alias("mix_position"))


def stored_in_order(mixed: DataFrame, rows_per_file: int = 8192) -> DataFrame:
    """The mixed rows dealt to partitions by position and sorted, so that reading the files in order mixes them.

    The partition follows from the position, so nothing is sampled and no key can be hot.
    """
    total = (mixed.agg(F.max("mix_position")).first()[0] or 0) + 1
    parts = max(1, -(-total // rows_per_file))
    part = F.floor(F.col("mix_position") / rows_per_file).cast("int")
    return mixed.repartitionById(parts, part).sortWithinPartitions("mix_position")
