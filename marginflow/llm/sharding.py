"""Rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair has a hash u in (0, 1); the key goes to the shard with the greatest weight / -ln(u). A new
shard takes rows only into itself, a removed one gives up only its own, and shares follow the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of each key: 0 to len(weights) - 1. A null key is a key like any other."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights have to be positive")
    # 53 bits of the hash, never 0 or 1; equal scores go to the lower shard
    u = lambda s: (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double") + 0.5) / float(1 << 53)
    scores = [F.struct((F.lit(float(w)) / -F.log(u(s))).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, size, text_crc32, shard, slot and grown_shard.

    size: UTF-8 bytes of the text plus 1 (null: 1); text_crc32 as unsigned (null: that of no bytes); slot: 0, 1, 2,
    ... within the shard, in order of a hash of the row, ties broken by all columns; grown_shard: the shard with one
    more of mean weight. The key and the weights alone decide the shard, so repeated keys share one. Texts are read
    but never moved.
    """
    data = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(key, (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), grown).alias("grown_shard"))
    ranked = gapless_rank(rows, ["shard"], [key], "slot")
    return ranked.select(key, "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
