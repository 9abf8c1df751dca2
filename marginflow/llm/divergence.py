"""Audit of how sources diverge from their language: term counts, their smoothed shares, and a divergence in integers.

Texts are counted where they are and only counts move. A term's postings are the sources it occurs in. Pairs of sources
are summed over postings; the terms that one of the two lacks come from each source's histogram of counts, since they
all score alike. The greatest terms of a group are searched by upper bounds: the terms of one group with one count
share p, so the least share that the language gives any of them bounds their scores; buckets are evaluated best bound
first, and those whose bound is strictly below the k-th score are never evaluated.

Everything is whole numbers: p = 1 + floor(10^9 (count + 1) / (N + V)), f = floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Documents of a language that a term has to be in.
LEAST_DOCUMENTS = 3
#: Terms reported for a group.
MOST_TERMS = 200
#: Distinct (lang, source, term) that a task counts before it passes them on.
HELD_TERMS = 300_000
#: Pairs of sources that are worked on at once.
PAIRS_AT_ONCE = 1 << 20

#: Bytes of terms: a-z, A-Z (lower-cased) and all of non-ASCII characters; the rest separates.
TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents, counted within tasks; a term may come up repeatedly.

    Null text, lang and source are read as empty. Texts are read whole; a task holds HELD_TERMS terms and one text's.
    """

    def run(batches):
        import pyarrow as pa

        n: dict[tuple, Counter] = {}
        df: dict[tuple, Counter] = {}

        def counted():
            for (lang, source), terms in n.items():
                some = df[lang, source]
                every = list(terms)
                for at in range(0, len(every), 1 << 16):
                    keys = every[at : at + (1 << 16)]
                    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(keys)), pa.repeat(pa.scalar(source, pa.string()), len(keys)), pa.array(keys, pa.binary()).cast(pa.string()), pa.array([terms[k] for k in keys], pa.int64()), pa.array([some[k] for k in keys], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])

        held = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
                terms = text.as_buffer().to_pybytes().translate(TERM_BYTES).split()
                if not terms:
                    continue
                key = lang, source
                if key not in n:
                    n[key], df[key] = Counter(), Counter()
                before = len(df[key])
                n[key].update(terms)
                df[key].update(set(terms))
                held += len(df[key]) - before
                if held > HELD_TERMS:
                    yield from counted()
                    n, df, held = {}, {}, 0
        yield from counted()

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(run, "lang string, source string, term string, n long, df long")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 1) / whole) in 64 bits, three digits at a time; count + 1 is at most about whole."""
    div = lambda a: F.call_function("div", a, whole)
    first = (count + 1) * 1000
    second = (first % whole) * 1000
    third = (second % whole) * 1000
    return div(first) * 1_000_000 + div(second) * 1000 + div(third) + 1


def score(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, sources, counts) of terms in at least ``least`` documents of their language. One shuffle."""
    dealt = term_counts(docs).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    lists = F.sort_array(F.collect_list(F.struct("source", "n")))
    found = summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), lists.alias("x")).where(F.col("df") >= least)
    return found.select("lang", "term", "total", F.col("x.source").alias("sources"), F.col("x.n").alias("counts"))


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, v, d, dl, p0, hist): every group with the number of kept terms of its language, the divisors of
    its shares and its language's, its share of a term it lacks, and [(share, terms with it)] of those it has. There
    are fewer distinct counts than the square root of twice its occurrences."""
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("nl"))
    has = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    has = has.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("n")).alias("ns"), F.collect_list(F.struct("c", "n")).alias("hist"))
    out = every.join(langs, "lang", "left").join(has, ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    out = out.select("lang", "source", F.coalesce("v", zero).alias("v"), (F.coalesce("ns", zero) + F.coalesce("v", zero)).alias("d"), (F.coalesce("nl", zero) + F.coalesce("v", zero)).alias("dl"), "hist")
    some = F.when(F.col("v") > 0, F.col("d"))
    hist = F.transform("hist", lambda x: F.struct(share(x["c"], some).alias("p"), x["n"].alias("n")))
    return out.select("lang", "source", "v", "d", "dl", F.coalesce(share(zero, some), zero).alias("p0"), F.coalesce(hist, F.array().cast("array<struct<p:bigint,n:bigint>>")).alias("hist"))


def _overlaps(entries: DataFrame) -> DataFrame:
    """(lang, source, item, w): over the terms that both sources have, what their scores differ from what the sums over
    histograms and absent terms take for them."""
    lists = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("x")).where(F.size("x") > 1)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def f(p, q):
            return (p - q) * (p - q) // q

        def pairs(lang, names, code, p, p0, left, right):
            keep = code[left] != code[right]
            left, right = left[keep], right[keep]
            w = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
            key = (lang[left] * len(names) + code[left]) * len(names) + code[right]
            return key, w

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            x = batch.column(1)
            sizes = np.diff(x.offsets.to_numpy())
            flat = x.flatten()
            sources = flat.field(0).dictionary_encode()
            names, code = sources.dictionary.to_pylist(), sources.indices.to_numpy().astype(np.int64)
            p, p0 = flat.field(1).to_numpy(), flat.field(2).to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            lang = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
            # entries, each with its whole posting on the other side, so many at a time
            owner = np.repeat(np.arange(len(sizes)), sizes)
            wide = sizes[owner]
            cut = np.cumsum(wide) // PAIRS_AT_ONCE
            for k in np.unique(cut):
                at = np.flatnonzero(cut == k)
                left = np.repeat(at, wide[at])
                begin = np.cumsum(wide[at]) - wide[at]
                right = np.arange(len(left)) - np.repeat(begin, wide[at]) + np.repeat(starts[owner[at]], wide[at])
                key, w = pairs(lang, names, code, p, p0, left, right)
                if not len(key):
                    continue
                order = np.argsort(key, kind="stable")
                key, w = key[order], w[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                total, key = np.add.reduceat(w, first), key[first]
                m = len(names)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // m // m)), pa.array([names[i] for i in key // m % m], pa.string()), pa.array([names[i] for i in key % m], pa.string()), pa.array(total)], names=["lang", "source", "item", "w"])

    parts = lists.select("lang", "x").mapInArrow(run, "lang string, source string, item string, w long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("w").alias("w"))


def source_pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each source and each other one of its language, the sum of scores over all
    kept terms. The result itself has a row for each such pair; nothing else grows with their number."""
    one = groups.select("lang", "source", "v", "p0", "hist")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("hist").alias("item_hist"))
    zero = F.lit(0).cast("long")
    p0, q0 = F.col("p0"), F.col("q0")
    present = lambda hist: F.aggregate(hist, zero, lambda a, x: a + x["n"])
    lone = F.aggregate("hist", zero, lambda a, x: a + x["n"] * score(x["p"], q0)) + F.aggregate("item_hist", zero, lambda a, x: a + x["n"] * score(p0, x["p"]))
    absent = (F.col("v") - present("hist") - present("item_hist")) * score(p0, q0)
    base = one.join(other, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, lone + absent).otherwise(zero).alias("base"))
    joined = base.join(_overlaps(entries), ["lang", "source", "item"], "left")
    return joined.select("lang", "source", "item", (F.col("base") + F.coalesce("w", zero)).alias("value"))


def top_terms(entries: DataFrame, k: int = MOST_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the k greatest scores of each group among its terms with p > q."""
    bucket = ["lang", "source", "c"]
    above = entries.where("p > q")
    bounds = above.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), score(F.min("p"), F.min("q")).alias("bound"))
    # best first until k terms are seen; a group has fewer buckets than the square root of twice its occurrences
    seen = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    bounds = checkpointed(bounds.withColumn("seen", F.coalesce(F.sum("n").over(seen), F.lit(0)) < k))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def evaluated(buckets: DataFrame) -> DataFrame:
        found = above.join(buckets.select(*bucket), bucket, "left_semi").select("lang", "source", F.col("term").alias("item"), score(F.col("p"), F.col("q")).alias("value"))
        return checkpointed(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))

    first = evaluated(bounds.where("seen"))
    kth = first.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
    # what is left can matter only where its bound reaches the k-th score
    more = bounds.where("NOT seen").join(kth, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth")
    both = first.drop("rank").unionByName(evaluated(more).drop("rank"))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("lang", "source", "item", "value", "rank")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, k: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of a group's language by the sum
    of scores, part ``term`` the group's terms that it has more of than its language, the first ``k``.

    Rank 1 is the greatest value; ties go to the item that is first by its UTF-8 bytes. Null text, lang and source are
    read as empty; repeated rows count each time; further columns are not read. A group without kept terms has pairs,
    with value 0 if its language keeps none, and no terms. An empty table gives no rows.
    """
    kept = checkpointed(postings(docs, least))
    groups = checkpointed(groups_of(docs, kept))
    entries = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("c"))
    entries = entries.join(groups.select("lang", "source", "d", "dl", "p0"), ["lang", "source"])
    entries = entries.select("lang", "term", "source", "c", "p0", share(F.col("c"), F.col("d")).alias("p"), share(F.col("total"), F.col("dl")).alias("q"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(groups, entries).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    terms = top_terms(entries, k).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
