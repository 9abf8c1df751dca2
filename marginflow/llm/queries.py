"""The queries of this subpackage and, where SQL can express them, the SQL that they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embeddings, langid, licenses, linededup, media, mixing, packing, sharding, simhash, toxicity, trie
from .common import read, train_split

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """Where the tokenizer file is; the same on every machine."""
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS vec_id, b AS r FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT vec_id, min(r) AS r FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(r, vec_id)) AS component_id, vec_id <= coalesce(r, vec_id) AS kept
FROM v LEFT JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""


#: Production shards: eight of equal weight.
SHARDS = (1.0,) * 8


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(read(spark, sf_dir, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 9))


def _op4_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    kept = [(name, b) for name in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[name] if (b := licenses.bigrams_of(t))]
    values = ", ".join(f"({k}, {quoted(n)}, [{', '.join(map(quoted, b))}])" for k, (n, b) in enumerate(kept))
    return f"""
WITH t(rank, license, own) AS (VALUES {values}),
l0 AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
l1 AS (SELECT doc_id, line, string_split(trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM l0),
l2 AS (SELECT doc_id, line, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS b FROM l1 WHERE len(w) > 1),
m AS (SELECT doc_id, line, license, rank, 2.0::DOUBLE * len(list_intersect(b, own)) / (len(b) + len(own)) AS dice, 2 * len(list_intersect(b, own)) >= 0.8::DOUBLE * (len(b) + len(own)) AS ok FROM l2, t),
best AS (SELECT doc_id, line, arg_max(license, {{'d': dice, 'r': -rank}}) AS license, max(dice) AS dice FROM m WHERE ok GROUP BY 1, 2)
SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n_lines, round(max(dice), 9) AS dice, min(line)::BIGINT AS first_line FROM best GROUP BY 1
""".replace("\\\\", "\\")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", train_split(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return clean.select("doc_id", n.alias("n_lines"), "n_deleted", F.md5("text_clean").alias("clean_md5"))


OP6_SQL = """
WITH raw AS (SELECT doc_id AS d, text, flatten(list_transform(string_split(replace(regexp_replace(replace(text, chr(10), chr(10) || chr(64976)), '([.!?;] )', '\\1' || chr(64976), 'g'), chr(12290), chr(12290) || chr(64976)), chr(64976)), lambda x: CASE WHEN strlen(x) > 160 THEN string_split(replace(x, ', ', ', ' || chr(64976)), chr(64976)) ELSE [x] END)) AS ps FROM documents),
l0 AS (SELECT d, unnest(ps) AS x, unnest(range(len(ps))) AS pos FROM raw),
l1 AS (SELECT d, pos, x, trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11) || chr(10)) AS t, coalesce(lag(x) OVER (PARTITION BY d ORDER BY pos) LIKE '%' || chr(10), true) AS nl FROM l0),
l2 AS (SELECT d, pos, nl, t, substr(md5(t), 1, 16) AS h, least(strlen(t) - strlen(replace(t, ' ', '')) + 1, strlen(replace(t, ' ', ''))) AS n FROM l1 WHERE t <> ''),
u AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, sum(n) OVER (PARTITION BY d)::BIGINT AS total,
             nl AND coalesce(lead(nl) OVER w, true) AS line FROM l2 WINDOW w AS (PARTITION BY d ORDER BY pos)),
g0 AS (SELECT d, i, s, n, line, CASE WHEN n >= 8 THEN h WHEN s + 8 <= total THEN substr(md5(list_aggregate(list(h) OVER (PARTITION BY d ORDER BY s RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING), 'string_agg', '')), 1, 16) END AS g FROM u),
g1 AS (SELECT *, CASE WHEN g IS NOT NULL THEN {'g': g, 'i': i} END AS x FROM g0),
g2 AS (SELECT d, CASE WHEN g IS NULL OR (line AND n > 8) THEN x WHEN line THEN min(x) OVER (PARTITION BY d ORDER BY s RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING)
              ELSE min(x) OVER (PARTITION BY d ORDER BY s ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS m FROM g1),
grams AS (SELECT *, lag(i) OVER (PARTITION BY d, g ORDER BY i) AS own FROM (SELECT DISTINCT d, m.i AS i, m.g AS g FROM g2 WHERE m IS NOT NULL)),
firsts AS (SELECT g, min({'d': d, 'i': i}) AS f FROM grams WHERE own IS NULL GROUP BY g HAVING count(*) > 1),
links AS (SELECT d, i, d AS d0, i - own AS shift FROM grams WHERE own IS NOT NULL UNION ALL SELECT d, i, f.d, i - f.i FROM grams JOIN firsts USING (g) WHERE own IS NULL AND d <> f.d),
parts AS (SELECT d, d0, shift, i // 256 AS stretch, greatest(min(i) - 16, shift, 0) AS lo, max(i) + 16 AS hi, list(i) AS hits FROM links GROUP BY d, d0, shift, i // 256),
same AS (SELECT p.d, p.d0, p.shift, p.stretch, a.i, list_contains(p.hits, a.i) AS hit FROM parts p JOIN u a ON a.d = p.d AND a.i BETWEEN p.lo AND p.hi JOIN u b ON b.d = p.d0 AND b.i = a.i - p.shift AND b.t = a.t),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY d, d0, shift, stretch ORDER BY i) AS run FROM same),
again AS (SELECT DISTINCT d, i FROM (SELECT d, i, bool_or(hit) OVER (PARTITION BY d, d0, shift, stretch, run) AS hit FROM runs) WHERE hit),
merged AS (SELECT d, min(i) AS lo, max(i) AS hi FROM (SELECT d, i, i - row_number() OVER (PARTITION BY d ORDER BY i) AS run FROM again) GROUP BY d, run),
sized AS (SELECT m.d, m.lo, m.hi, sum(u.n) AS words FROM merged m JOIN u ON u.d = m.d AND u.i BETWEEN m.lo AND m.hi GROUP BY ALL),
edges AS (SELECT d, i FROM u WHERE nl UNION ALL SELECT d, max(i) + 1 FROM u GROUP BY d),
short AS (SELECT z.d, min(e.i) AS lo, max(e.i) - 1 AS hi FROM sized z JOIN edges e ON e.d = z.d AND e.i BETWEEN z.lo AND z.hi + 1 WHERE z.words < 24 GROUP BY z.d, z.lo HAVING max(e.i) > min(e.i)),
gone AS (SELECT d, lo, hi FROM sized WHERE words >= 24 UNION ALL SELECT s.d, s.lo, s.hi FROM short s JOIN u ON u.d = s.d AND u.i BETWEEN s.lo AND s.hi GROUP BY ALL HAVING sum(u.n) >= 8),
cut AS (SELECT g.d, g.lo, g.hi, a.pos AS at, b.pos AS until, NOT a.nl AS mid, NOT a.nl AND EXISTS (SELECT 1 FROM u WHERE u.d = g.d AND u.nl AND u.i BETWEEN g.lo + 1 AND g.hi + 1) AS feed
        FROM gone g JOIN u a ON a.d = g.d AND a.i = g.lo JOIN u b ON b.d = g.d AND b.i = g.hi),
dead AS (SELECT u.d, u.pos, c.feed AND u.i = c.lo AS feed FROM u JOIN cut c ON c.d = u.d AND u.i BETWEEN c.lo AND c.hi),
left_over AS (SELECT l0.d, string_agg(CASE WHEN dead.pos IS NULL THEN l0.x WHEN dead.feed THEN chr(10) ELSE '' END, '' ORDER BY l0.pos) AS text FROM l0 LEFT JOIN dead USING (d, pos) GROUP BY l0.d),
ended AS (SELECT c.d FROM cut c JOIN raw r USING (d) WHERE c.until = len(r.ps) - 1 AND NOT c.mid),
counts AS (SELECT d, count(*) AS n FROM dead GROUP BY d)
SELECT r.d AS doc_id, coalesce(len(string_split(r.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_deleted,
       md5(CASE WHEN c.n IS NULL THEN r.text WHEN e.d IS NOT NULL AND o.text LIKE '%' || chr(10) THEN left(o.text, -1) ELSE o.text END) AS clean_md5
FROM raw r LEFT JOIN counts c USING (d) LEFT JOIN left_over o USING (d) LEFT JOIN ended e USING (d)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_phase", "mix_slot", "mix_position")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents")).drop("wav")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score_documents(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", train_split(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_matched")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations")).drop("first", "last")


#: DuckDB has no CRC-32, so its register is shifted bit by bit.
OP11_SQL = """
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x.r, substr(x.t, 1, 64), md5(x.t)) AS xs FROM t GROUP BY 1),
bits AS (SELECT *, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS es FROM own),
h AS (SELECT conv_id, xs, conv_id - conv_id % 100 AS base, xor(list_reduce(es, lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)), 4294967295::BIGINT), 4294967295) % 6 AS h FROM bits),
paths AS (SELECT h.conv_id, list_concat(coalesce(b.xs[1:h.h], []), h.xs[h.h + 1:]) AS xs FROM h LEFT JOIN own b ON b.conv_id = h.base),
pre AS (SELECT conv_id, d, xs[1:d] AS node, d = len(xs) AS here FROM (SELECT conv_id, xs, unnest(range(len(xs) + 1)) AS d FROM paths)),
n AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN here THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM pre GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, node[1:d - 1] AS node, count(*) AS k FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k, 0) AS k, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.node[-1].t) END AS saved FROM n LEFT JOIN kids USING (d, node)),
subs AS (SELECT a.d, a.node, count(*) FILTER (b.k = 0) AS leaves, sum(b.saved) AS saved FROM m a JOIN m b ON b.d >= a.d AND b.node[1:a.d] = a.node GROUP BY 1, 2)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.k AS n_children, subs.leaves AS n_leaves, subs.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN subs USING (d, node) LEFT JOIN m p ON p.d = m.d - 1 AND p.node = m.node[1:m.d - 1]
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS df FROM (SELECT d, lang, source, unnest(ts) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(df) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS ns FROM c JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(ns, 0) AS ns, coalesce(nl, 0) AS nl FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang) LEFT JOIN sums USING (lang, source)),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.ns + g.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 1) // (g.nl + g.v) AS q
      FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM x WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path()).drop("padding")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_embeddings": op2_embeddings,
    "op3_sharding": op3_sharding,
    "op4_licenses": op4_licenses,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_media": op9_media,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_packing": op13_packing,
    "pipeline": pipeline,
}
#: Without SQL: 1 and 9 (Python libraries), 3 (no CRC-32 in DuckDB), 5 and 10 (fitted), 7 (no XXH64), 8 (a simulated
#: schedule), 13 (the tokenizer) and the pipeline. Tests hold these against brute force.
ORACLES: dict[str, str] = {"op2_embeddings": OP2_SQL, "op4_licenses": _op4_sql(), "op6_line_dedup": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_source_divergence": OP12_SQL}
