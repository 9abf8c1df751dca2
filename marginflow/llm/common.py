"""Helpers that several operators share: reading tables, cutting lineage, gapless ranks, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader (the folder may be in a store only Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that lost executors cost no lineage.

    The folder is the session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder is set, but
    only in local mode, in which driver and executors share a disk.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def slices(batches, rows: int = 256):
    """Arrow batches cut to at most ``rows`` rows: what a function makes of a batch takes memory beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def train_split(doc_id: Column) -> Column:
    """True for held-out rows: crc32 of the id as text leaves remainder 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def row_hash(df: DataFrame) -> Column:
    """A hash of all of a row that can be hashed, to break ties: rows with the same one are the same."""
    return F.xxhash64(*[f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def gapless_rank(df: DataFrame, groups: list[str], order: list[str], out: str, buckets: int = 4096) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each group, without sending a group or a repeated key to one task.

    Rows are dealt by (group, bucket of the order columns' and the whole row's hash). Counts per (group, bucket), at
    most ``buckets`` rows a group, give each bucket its offset; rows are numbered within their bucket only, in order
    of ``order`` and then of the whole row's hash, so that a task that is run again numbers them the same. The count
    and the numbering both partition by (group, bucket), so the rows move once. Null group values form one group.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    keyed = df.withColumn("__tie", row_hash(df)).withColumn("__b", F.pmod(F.xxhash64(*order, "__tie"), F.lit(buckets)).cast("int"))
    for key, group in zip(keys, groups, strict=True):
        # one non-null string key for each value, so that joins match nulls
        keyed = keyed.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null")))
    counts = keyed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__b").orderBy(*order, "__tie")
    ranked = keyed.join(offsets, [*keys, "__b"]).withColumn(out, F.col("__before") + F.row_number().over(within) - 1)
    return ranked.select(*df.columns, out)


def running(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str | None = None) -> DataFrame:
    """Adds ``rank`` (0, 1, 2, ... over all rows) and, for each out: column of ``sums``, the column's sum over the rows
    up to and including this one, in ``order``.

    Rows are dealt by range of ``order`` and summed within their task, batch by batch; the tasks' totals, one row a
    task, give each its offset. ``order`` has to be total (equal keys go to one task). What it was dealt by is written
    before it is summed up, so that a task run again finds the same rows. Sums are of 64 bits; nulls count as 0.
    """
    spark, outs = df.sparkSession, [*sums, *([rank] if rank else [])]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())
    schema = StructType([*dealt.schema.fields, *(StructField(name, LongType()) for name in outs)])
    kept = list(dealt.columns)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        before = [0] * len(outs)
        for batch in batches:
            if not batch.num_rows:
                continue
            made = []
            for k, name in enumerate(outs):
                x = pc.fill_null(batch.column(kept.index(sums[name])), 0).to_numpy(zero_copy_only=False).astype(np.int64) if name in sums else np.ones(batch.num_rows, np.int64)
                up = np.cumsum(x) + before[k]
                before[k] = int(up[-1])
                made.append(pa.array(up))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*kept, *outs])

    local = checkpointed(dealt.mapInArrow(run, schema))
    # sums only grow if their terms are not negative, so a task's total is its terms' sum, not its last sum
    ends = sorted(map(tuple, local.groupBy("__pid").agg(*(F.sum(sums[o]).cast("long") if o in sums else F.count(F.lit(1)) for o in outs)).collect()))
    offsets, so_far = [], [0] * len(outs)
    for pid, *totals in ends:
        offsets.append((pid, *so_far))
        so_far = [a + (b or 0) for a, b in zip(so_far, totals, strict=True)]
    table = spark.createDataFrame(offsets, "__pid int, " + ", ".join(f"__o{k} long" for k in range(len(outs))))
    # one row a task: small by nature
    joined = local.join(F.broadcast(table), "__pid")
    return joined.select(*df.columns, *((F.col(o) + F.col(f"__o{k}") - (1 if o == rank else 0)).alias(o) for k, o in enumerate(outs)))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component being the least node.

    Alternates large-star and small-star steps, each a minimum by key and a join, until the edges are stars;
    a number of rounds near the logarithm of the longest path is usual. Every round is checkpointed. Only two
    numbers a round reach the driver. Self-links and repeated links are fine; nulls are dropped; no edges give
    no rows.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = checkpointed(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined, so that the join can split a node with very many links
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
