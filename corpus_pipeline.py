"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import gc
import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginflow.llm import bpe, langid, linededup, mixing, simhash
from marginflow.llm.common import checkpointed, read
from marginflow.llm.queries import tokenizer_path


def aside(docs: DataFrame) -> DataFrame:
    """The columns under names that no operator uses, so that none of them clashes with a result's."""
    return docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])


def back(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns set aside under their own names again."""
    return result.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language. ``und`` (null or without a letter) and texts whose nearest codeword is
    ambiguous are rejected; ``lang`` becomes the predicted language."""
    kept = aside(docs)
    names = dict(zip(docs.columns, kept.columns))
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.predict(kept.withColumn("text", F.col(names["text"])), model, keep=tuple(kept.columns))
    found = found.where("lang_pred <> 'und' AND NOT ambiguous").withColumn(names["lang"], F.col("lang_pred"))
    return back(found, docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines and passages, however much of a document they are; ``n_chars``
    follows the text. All documents stay, a whole copy as an empty one."""
    clean = linededup.dedup_lines(docs, out="text", count="__deleted")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def not_least(found: DataFrame) -> DataFrame:
    """Ids of near-duplicates of a document of a lesser id. Where rows that share an id lie in several groups, the id
    goes if one of them is not its group's least."""
    return checkpointed(found.groupBy("doc_id").agg(F.min("component_id").alias("least")).where("least < doc_id").select("doc_id"))


def let_go(spark: SparkSession) -> None:
    """Lets Spark remove shuffles and checkpoints that nothing refers to any more: its cleaner goes by the garbage
    collectors of Python and of the JVM, which may not run for long."""
    gc.collect()
    spark._jvm.System.gc()


def as_given(spark: SparkSession, docs: DataFrame, sf_dir: str) -> list[DataFrame]:
    """The texts that the documents came with, from the table in ``sf_dir``, ids in the type that they have in ``docs``.
    None if no folder is given, or, with a warning, if it has no such table: a stage is told of ``docs`` first."""
    if not sf_dir:
        return []
    try:
        table = read(spark, sf_dir, "documents")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        warnings.warn(f"{sf_dir} has no documents: near-duplicates are judged by the texts that line dedup left only", stacklevel=2)
        return []
    return [table.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")]


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component (five-word shingles, similarity of 0.8 or more), the one of
    the least id, once if it is repeated. Documents without an id can't be told from one another, so all of them stay.

    Line dedup has taken from a copy what it shares, so documents are judged first by the texts that they came with
    (those of the table in ``sf_dir``, if it has one), then those that are left by the texts that they have now.
    """
    ids = checkpointed(docs.select("doc_id").where("doc_id IS NOT NULL").distinct())
    for texts in [*as_given(spark, docs, sf_dir), docs]:
        gone = not_least(simhash.near_texts(texts.select("doc_id", "text"), only=ids))
        ids = checkpointed(ids.join(gone, "doc_id", "left_anti"))
        del gone
        let_go(spark)  # what the first judgement wrote would lie beside what the second writes
    kept = docs.join(ids, "doc_id", "left_semi").select(*docs.columns)
    # rows that share an id: the first in order of the row's hash; few ids have several
    again = checkpointed(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("row.*")
    alone = docs.join(ids.join(again, "doc_id", "left_anti"), "doc_id", "left_semi").select(*docs.columns)
    return alone.unionByName(once).unionByName(docs.where("doc_id IS NULL"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders the documents so that reading the files in order mixes the sources to their target weights."""
    kept = aside(docs)
    names = dict(zip(docs.columns, kept.columns))
    mixed = mixing.mix(kept, source=names["source"], order=(names["doc_id"],))
    return back(mixing.stored_in_order(mixed), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, in the order of the mixed rows."""
    return bpe.encode_documents(docs, tokenizer_path(), keep=("doc_id", "source"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: Language ID, BPE and the schedule can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder ``spark.checkpoint.dir``, so a
    lost executor costs no more than the running stage. Where that is unset (tests), checkpoints are used."""
    docs = read(spark, sf_dir, "documents")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}" if shared else None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return docs
        if folder:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:  # only the last table is needed any more
                _drop(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        else:
            docs = checkpointed(docs)
    return docs
