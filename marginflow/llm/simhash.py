"""SimHash near-duplicates, all pairs within the radius found by covering locality-sensitive hashing.

Bit i of a fingerprint has a code m(i) of radius + 1 bits. For each non-zero v of as many bits, table v keeps the
fingerprint's bits whose code has an odd number of ones in common with v. Codes of up to ``radius`` differing bits
do not span the space, so some v has an even number in common with each: that table keeps none of these bits, and
the two fingerprints are equal in it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import with_code
from .common import checkpointed, components, slices

RADIUS = 4
SHINGLE = 4
#: Most fingerprints of a bucket that one tile compares with as many others.
TILE = 512
#: Shingles hashed at a time.
BLOCK = 1 << 16


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each covering table keeps, as signed 64-bit integers."""
    n = (1 << (radius + 1)) - 1
    code = [i % n + 1 for i in range(64)]
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(64) if (code[i] & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit i is 1 if set in over half the shingles' XXH64 values. No words: 0."""
    from xxhash import xxh64_intdigest as xxh

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = [xxh(b" ".join(words[i : i + shingle]), 42) for i in range(at, min(n, at + BLOCK))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row; a null or empty text, or one without words, has fingerprint 0."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[doc_id, "fp"])

    return with_code(docs).select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, fp long")


def forest(sigs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Fewer links (row, row) than rows of ``sigs`` that connect what rows with ``most`` differing bits connect.

    Rows (of one or several 64-bit words) are gathered around centres: members lie within ``most`` bits of their
    centre and are linked to it. Two gatherings are compared only if their centres are within three times that and
    not connected yet, and then only until a pair within it is found.
    """
    sigs = sigs.reshape(len(sigs), -1)
    apart = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)).sum(1, dtype=np.int64)
    links, groups, rest = [], [], np.arange(len(sigs))
    while len(rest):
        hit = apart(sigs[rest], sigs[rest[0]]) <= most
        group, rest = rest[hit], rest[~hit]
        links += [(int(i), int(group[0])) for i in group[1:]]
        groups.append(group)
    root = list(range(len(groups)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    centres = sigs[[g[0] for g in groups]] if groups else sigs[:0]
    for i, g in enumerate(groups):
        for j in np.flatnonzero(apart(centres[:i], centres[i]) <= 3 * most):
            if find(i) == find(j):
                continue
            h = groups[j]
            small, large = (g, h) if len(g) <= len(h) else (h, g)
            for k in small:
                hit = np.flatnonzero(apart(sigs[large], sigs[k]) <= most)
                if len(hit):
                    links.append((int(k), int(large[hit[0]])))
                    root[find(i)] = find(j)
                    break
    return links


def covering_keys(fingerprints: list[Column], radius: int = RADIUS) -> Column:
    """A key for each fingerprint and covering table; two rows share one if any fingerprint has a table in common."""
    return F.array(*[F.xxhash64(F.lit(64 * n + t), fp.bitwiseAND(F.lit(m))) for n, fp in enumerate(fingerprints) for t, m in enumerate(masks(radius))])


def linked(nodes: DataFrame, keys: Column, sig: list[str], most: int, tile: int = TILE) -> DataFrame:
    """(id, component): of ``nodes`` (id long, once each, and the columns ``sig``) those linked with another one. Nodes
    are linked if they share one of ``keys`` and their signatures differ in ``most`` bits or fewer; a component is
    what links connect, named by a member.

    First, in each bucket, members are linked to its least one, and buckets of two are thereby settled. Where that
    leaves a bucket with several components, those besides the largest are compared with all of it: blocks of about
    ``tile`` nodes are dealt, a pair of blocks to a tile, so that no bucket has to fit one task. A dense group of near
    copies is mostly one component by then; a tile gives fewer links than it has nodes.
    """
    spread = nodes.select("id", F.explode(keys).alias("key"))
    buckets = checkpointed(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1"))
    apart = lambda x, y: sum((F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in sig), F.lit(0))
    other = lambda side: nodes.select(F.col("id").alias(side), *[F.col(c).alias(side + c) for c in sig])
    ends = buckets.select("a", "b").where("n = 2").join(other("a"), "a").join(other("b"), "b")
    pairs = ends.where(apart("a", "b") <= most).select("a", "b")
    many = checkpointed(spread.join(buckets.where("n > 2").select("key", "a"), "key").join(nodes.select("id", *[F.col(c).alias("b" + c) for c in sig]), "id"))
    stars = many.where("a <> id").join(other("a"), "a").where(apart("a", "b") <= most).select("a", F.col("id").alias("b"))
    first = checkpointed(components(pairs.unionByName(stars)).withColumnRenamed("node", "id"))

    members = checkpointed(many.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"), *["b" + c for c in sig]))
    counts = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    split = counts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("n"), F.max(F.struct("m", "c")).alias("top")).where("parts > 1")
    split = checkpointed(split.select("key", F.col("top.c").alias("top"), F.ceil((F.col("n") - F.col("top.m")) / tile).alias("few"), F.ceil(F.col("top.m") / tile).alias("rest")))
    # blocks 0 to few - 1 hold what is outside the largest component, the others that component
    dealt = members.join(split, "key")
    h = F.xxhash64("id")
    k = F.when(F.col("c") == F.col("top"), F.col("few") + F.pmod(h, F.col("rest"))).otherwise(F.pmod(h, F.col("few")))
    dealt = dealt.withColumn("k", k)
    partners = F.when(F.col("k") < F.col("few"), F.col("few") + F.col("rest")).otherwise(F.col("few"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), partners - 1))).where("k <> j OR few = 1 AND rest = 0")
    lo, hi = F.least("k", "j"), F.greatest("k", "j")
    dealt = dealt.select(F.xxhash64("key", lo, hi).alias("tile"), "key", lo.alias("lo"), hi.alias("hi"), "c", *["b" + c for c in sig])
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "key", "lo", "hi")

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []  # one tile can go over several batches
        at = None

        def done() -> list[tuple[int, int]]:
            c, sigs = (np.concatenate(x) for x in zip(*held, strict=True))
            return [(int(c[i]), int(c[j])) for i, j in forest(sigs, most) if c[i] != c[j]]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5 + len(sig))]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:4]])) + 1
            out = []
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                key = tuple(int(c[start]) for c in columns[:4])
                if at is not None and key != at:
                    out += done()
                    held = []
                at = key
                held.append((columns[4][start:stop], np.column_stack([c[start:stop] for c in columns[5:]])))
            yield batch_of(out)
        if held:
            yield batch_of(done())

    # links between components already found
    second = components(with_code(dealt).mapInArrow(run, "a long, b long")).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    known = first.unionByName(second.select(F.col("component").alias("id"), "component").join(first, "id", "left_anti"))
    return known.join(second, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))


def near_components(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, component): of the distinct fingerprints of ``nodes`` (column fp) those linked with another one."""
    ids = nodes.select(F.col("fp").alias("id"), F.col("fp").alias("s"))
    return linked(ids, covering_keys([F.col("s")], radius), ["s"], radius, tile).withColumnRenamed("id", "fp")


def _spread(rows: DataFrame, nodes: DataFrame, parts: DataFrame, key: str, doc_id: str) -> DataFrame:
    """The rows with component_id: nodes (key, least) and their components give each component's least id. Minima are
    written before they are joined, so that the join can split a component with most of the nodes."""
    of = checkpointed(nodes.join(parts, key, "left").select(key, "least", F.coalesce("component", key).alias("component")))
    ids = checkpointed(of.groupBy("component").agg(F.min("least").alias("component_id")))
    return rows.join(checkpointed(of.join(ids, "component").select(key, "component_id")), key).select(*rows.columns, "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked; component_id is the least id reachable.
    Null ids take part and are ignored in the minimum (null where a component has no other). Repeated rows give
    repeated rows; texts without words all have fingerprint 0 and form one component. No rows give no rows.
    """
    fps = checkpointed(fingerprints(docs, doc_id, text))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min(doc_id).alias("least")))
    return _spread(fps, nodes, near_components(nodes.select("fp"), radius), "fp", doc_id).select(doc_id, "fp", "component_id")


#: Bits of 256 in which texts whose five-word shingles have a Jaccard similarity of 0.8 differ: acos(8 / 9) / pi of
#: them, 38.8 on average with a deviation of 5.7; one and a half are allowed on top.
WIDE_BITS = 47
WIDE_SHINGLE = 5


def _bits(items: list[bytes], words: int) -> list[int]:
    """A SimHash of 64 times ``words`` bits, as unsigned words: bit i is 1 if set in over half the items' hashes."""
    from xxhash import xxh3_128_digest as xxh

    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(items), BLOCK):
        part = items[at : at + BLOCK]
        raw = [b"".join([xxh(x, seed) for x in part]) for seed in range(words // 2)]
        ones += np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8).reshape(len(part), 16), axis=1).sum(0, dtype=np.int64) for r in raw])
    return np.packbits(2 * ones > len(items)).view(">u8").tolist()


def signature(text: str | None) -> list[int]:
    """Two fingerprints of the text's distinct words, by which candidates are found, and four words of 64 bits of
    its distinct five-word shingles, by which they are judged. Without words all are 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return [0] * 6
    n = max(1, len(words) - WIDE_SHINGLE + 1)
    return _bits(sorted(set(words)), 2) + _bits(list({b" ".join(words[i : i + WIDE_SHINGLE]) for i in range(n)}), 4)


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = WIDE_BITS, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, sig, component_id) for each row of ``docs``: near-duplicates by five-word shingles at a similarity of
    about 0.8 or more.

    An edited word changes five shingles but one word, so fingerprints of distinct words lie closer than those of
    shingles: covering tables of radius 4 over two of them give the candidates, and a 256-bit SimHash of the shingles
    judges them. ``sig`` is a hash of the signature. Nulls, ties and texts without words are as in
    ``near_duplicates``. ``only``: ids, once each, to which rows are limited once they have signatures, so that texts
    stay where they are.
    """
    names = ["f0", "f1", "s0", "s1", "s2", "s3"]

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            got = np.array([signature(x.as_py()) for x in batch.column(1)], np.uint64).reshape(-1, 6).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(got[:, i])) for i in range(6))], names=[doc_id, *names])

    kinds = ", ".join([f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}", *[f"{n} long" for n in names]])
    rows = with_code(docs).select(doc_id, text).mapInArrow(run, kinds).withColumn("id", F.xxhash64(*names))
    rows = checkpointed(rows if only is None else rows.join(only, doc_id, "left_semi"))
    nodes = checkpointed(rows.groupBy("id").agg(F.min(doc_id).alias("least"), *[F.first(n).alias(n) for n in names]))
    parts = linked(nodes.drop("least"), covering_keys([F.col("f0"), F.col("f1")]), names[2:], most)
    found = _spread(rows.select(doc_id, "id"), nodes.select("id", "least"), parts, "id", doc_id)
    return found.select(doc_id, F.col("id").alias("sig"), "component_id")
