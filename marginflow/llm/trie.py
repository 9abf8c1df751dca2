"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns. Its key is its depth and a 128-bit exclusive-or of hashes of (position,
turn), so prefixes of one conversation of any length are a running sum that can be taken in stretches. Distinct
conversations are ranked lexicographically; what ranks them is the turn taken at each *branching* node on their path.
There are few: a path with m of them needs m more conversations of 1, 2, ..., m turns, hence m is below the square
root of twice the number of turns, whatever the length of the path.

A node's members are then an interval of ranks. Nodes in order of (first rank, depth) are in preorder; a subtree ends
where its last rank does, and sums over subtrees are differences of two prefix sums.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, running

#: Turns of a conversation that are summed in one window.
STRETCH = 4096
#: Ids that are joined into one text before they are sent to their node's digest.
DIGEST_IDS = 2048
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "x1", "x2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn_key, n_chars): turns numbered 1, 2, ... in each conversation by ``turn`` (null first).

    Null roles and texts become empty; rows without a conv_id belong to no conversation and are left out. Turns of
    the same number come in order of role, then of the text's first 64 characters, then of its digest; repeated rows
    stay. A conversation of any length is numbered in stretches; texts are not moved. ``turn_key`` is the MD5 of
    role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("__role"), F.substring(text, 1, 64).alias("__head"), key.alias("turn_key"), F.char_length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("__row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("__role"), F.col("__head"), F.col("turn_key"), F.col("__row")]
    ranked = running(turns, order, {}, rank="__at").select("conv_id", "turn_key", "n_chars", "__at")
    first = checkpointed(ranked.groupBy("conv_id").agg(F.min("__at").alias("__first")))
    return ranked.join(first, "conv_id").select("conv_id", (F.col("__at") - F.col("__first") + 1).alias("position"), "turn_key", "n_chars")


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their head from their block's first one: (conv_id, depth, turn_key, n_chars) rows, and
    (conv_id) of all, also those left without a turn.

    Conversation c begins with the first h turns of conversation c - c % block (fewer if it has fewer, none if it is
    absent), h being crc32(c) % heads, and goes on with its own turns after its first h. ``%`` is the truncated
    remainder. ``turns`` is what ``numbered`` gives.
    """
    turns = checkpointed(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), h.alias("h"))
    own = checkpointed(own)
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n").alias("nb"))
    convs = checkpointed(own.join(sizes, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("nb", F.lit(0))).alias("k")))
    rest = turns.join(convs.select("conv_id", "h", "k"), "conv_id").where("position > h").select("conv_id", (F.col("k") + F.col("position") - F.col("h")).alias("depth"), "turn_key", "n_chars")
    head = turns.where((F.col("conv_id") % block == 0) & (F.col("position") < heads)).withColumnRenamed("conv_id", "base")
    head = head.join(convs.select("conv_id", "base", "h"), "base").where("position <= h").select("conv_id", F.col("position").alias("depth"), "turn_key", "n_chars")
    return rest.unionByName(head), convs.select("conv_id")


def _keyed(turns: DataFrame) -> DataFrame:
    """Each turn with its node's key (depth, x1, x2) and its parent's (p1, p2)."""
    rows = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "n_chars", *(F.xxhash64(F.lit(k), F.col("depth").cast("long"), "turn_key").alias(f"e{k}") for k in (1, 2)))
    rows = rows.withColumn("__s", F.floor(F.col("depth") / STRETCH).cast("long"))
    up = "OVER (PARTITION BY conv_id, __s ORDER BY depth ROWS UNBOUNDED PRECEDING)"
    rows = checkpointed(rows.select("*", *(F.expr(f"bit_xor(e{k}) {up}").alias(f"x{k}") for k in (1, 2))))
    # later stretches of a long conversation start from what the earlier ones come to
    ends = rows.groupBy("conv_id", "__s").agg(*(F.bit_xor(f"e{k}").alias(f"t{k}") for k in (1, 2)))
    before = Window.partitionBy("conv_id").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    long_ones = rows.where("__s > 0").select("conv_id").distinct()
    ends = ends.join(long_ones, "conv_id", "left_semi")
    carry = checkpointed(ends.select("conv_id", "__s", *(F.bit_xor(f"t{k}").over(before).alias(f"c{k}") for k in (1, 2))).where("__s > 0"))
    whole = rows.where("__s = 0").withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")})
    whole = whole.unionByName(rows.where("__s > 0").join(carry, ["conv_id", "__s"]))
    x = {k: F.col(f"x{k}").bitwiseXOR(F.col(f"c{k}")) for k in (1, 2)}
    return whole.select("conv_id", "depth", "n_chars", "e1", "e2", x[1].alias("x1"), x[2].alias("x2"), x[1].bitwiseXOR(F.col("e1")).alias("p1"), x[2].bitwiseXOR(F.col("e2")).alias("p2"))


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the node's conv_ids, ascending and joined by commas. Ids are joined in stretches
    of up to DIGEST_IDS where they were sorted; a digest reads those in order, one row at a time."""
    kinds = "depth long, x1 long, x2 long, "
    dealt = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def joined(batches):
        import itertools

        import pyarrow as pa

        def groups():
            rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
            for key, members in itertools.groupby(rows, lambda r: r[:3]):
                while some := [r[3] for r in itertools.islice(members, DIGEST_IDS)]:
                    yield (*key, some[0], ",".join(map(str, some)))

        out = groups()
        while some := list(itertools.islice(out, 1024)):
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "x1", "x2", "at", "ids"), r, strict=True)) for r in some])

    def digested(batches):
        import itertools

        import pyarrow as pa

        def groups():
            rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
            for key, members in itertools.groupby(rows, lambda r: r[:3]):
                h = hashlib.sha256()
                for k, r in enumerate(members):
                    h.update((("," if k else "") + r[4]).encode())
                yield (*key, h.hexdigest())

        out = groups()
        while some := list(itertools.islice(out, 4096)):
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "x1", "x2", "ends_sha256"), r, strict=True)) for r in some])

    parts = dealt.select(*NODE, "conv_id").mapInArrow(joined, kinds + "at long, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "at").mapInArrow(digested, kinds + "ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row a node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the interval of its subtree in preorder, ``first`` to ``last``.

    ``turns``: (conv_id, depth from 1, turn_key, n_chars), gapless in each conversation; ``members``: (conv_id) of all
    conversations, each once, also those without a turn. The root, depth 0, stands for all of them; without any
    there is no row. A conversation with very many turns, a turn that very many share and very many equal
    conversations are each split over tasks.
    """
    keyed = checkpointed(_keyed(turns))
    # each conversation's last node; equal conversations are one class from here on
    ends = keyed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    none = F.lit(0).cast("long")
    ends = checkpointed(members.join(ends, "conv_id", "left").select("conv_id", *(F.coalesce(c, none).alias(c) for c in NODE)))
    classes = checkpointed(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")))
    paths = checkpointed(keyed.drop("e1", "e2").join(classes.select("conv_id", "n"), "conv_id"))
    # nodes with several children, and the child that each path takes there
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    children = checkpointed(paths.select(*NODE, "p1", "p2").distinct().groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children")))
    forks = checkpointed(children.where("n_children > 1").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2")))
    taken = paths.select("conv_id", *NODE, "p1", "p2").join(forks, ["depth", "p1", "p2"], "left_semi")
    turn = F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("x1", "x2")))
    keys = taken.select("conv_id", F.struct("depth", turn.alias("turn")).alias("t")).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("t")).getField("turn"), "").alias("__key"))
    keyed_classes = classes.join(keys, "conv_id", "left").select("conv_id", "depth", "n", F.coalesce("__key", F.lit("")).alias("__key"))
    # classes of one key lie on one path: the shorter one first
    ranked = checkpointed(running(keyed_classes, [F.col("__key"), F.col("depth")], {}, rank="r").select("conv_id", "n", "r"))
    # members of a node: an interval of ranks
    at = paths.join(ranked.select("conv_id", "r"), "conv_id")
    span = [F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    nodes = at.groupBy(*NODE).agg(*span, F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n_chars").alias("n_chars"))
    root = ranked.agg(*span).where("lo IS NOT NULL").select(*(none.alias(c) for c in NODE), "lo", "hi", "n_convs", "conv_id", *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), none.alias("n_chars"))
    nodes = checkpointed(nodes.unionByName(root))
    counted = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", none))
    counted = counted.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_chars")})
    ordered = running(counted, [F.col("lo"), F.col("depth")], {"leaves": "leaf", "savings": "saved"}, rank="first")
    ordered = checkpointed(ordered)
    # where the last node of each rank lies, and the sums up to it
    until = checkpointed(ordered.groupBy(F.col("lo").alias("hi")).agg(F.max("first").alias("last"), F.max("leaves").alias("l"), F.max("savings").alias("s")))
    sums = {"n_leaves": F.col("l") - F.col("leaves") + F.col("leaf"), "saved_tokens": F.col("s") - F.col("savings") + F.col("saved")}
    summed = ordered.join(until, "hi").withColumns(sums)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    summed = summed.join(above, ["depth", "p1", "p2"], "left")
    summed = summed.join(checkpointed(_digests(ends)), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "first", "last")


def prefix_trie(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text); see ``numbered``, ``rebuilt``
    and ``trie``. Other columns are not read. An empty table gives no rows."""
    return trie(*rebuilt(numbered(conversations), block, heads))
