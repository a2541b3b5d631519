"""A training corpus from the documents table, in five written stages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanvigil.llm import decontaminate, jaccard_join, mixing, pii, quality_rules
from spanvigil.llm.text import read
from spanvigil.session import checkpoint_dir, materialise


def _print() -> Column:
    """A document's id and text as one long; a null id is a value like others."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.length("text"))


def _named(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the documents do not have."""
    return [name + "_" * (1 + max((len(c) for c in docs.columns if c.startswith(name)), default=0)) for name in names]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rejected ones go.

    The verdict depends on the text alone, so it is carried back by id and text.
    """
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    print_ = F.struct(F.col("doc_id"), F.xxhash64("text"), F.length("text"))
    mark, gone = _named(docs, "_print", "_gone")
    judged = quality_rules.quality_rules(docs.withColumn(mark, print_), trusted, keep=(mark,))
    rejected = materialise(judged.where(~F.col("kept")).select(F.col(mark).alias(gone)).distinct())
    return docs.join(rejected, print_.eqNullSafe(F.col(gone)), "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Documents are told apart by id and text, as ids can be null or repeated; a null
    id comes last.  Of rows that are equal in both, the smallest stays.
    """
    (mark,) = _named(docs, "_print")
    named = docs.withColumn(mark, _print())
    groups = materialise(jaccard_join.jaccard_components(named, key=mark)).withColumnRenamed(mark, "_print")
    ids = named.select(F.col(mark).alias("_print"), "doc_id").distinct()
    linked = groups.where("component_id <> _print")
    roots = linked.select(F.col("component_id").alias("_print"), "component_id")
    members = materialise(linked.select("_print", "component_id").unionByName(roots).distinct().join(ids, "_print"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_print"))["_print"]
    stays = members.groupBy("component_id").agg(first.alias("_print")).select("_print")
    gone = materialise(members.join(stays, "_print", "left_anti").select(F.col("_print").alias(mark)))
    left = named.join(gone, mark, "left_anti")
    repeated = materialise(groups.groupBy("_print").count().where("count > 1").select(F.col("_print").alias(mark)))
    # Of rows with one id and text that whose JSON is smallest: a map has no order of its own.
    row = F.struct(*docs.columns)
    one = left.join(repeated, mark, "left_semi").groupBy(mark).agg(F.min_by(row, F.to_json(row)).alias("row"))
    alone = left.join(repeated, mark, "left_anti").select(*docs.columns)
    return alone.unionByName(one.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the verdict is carried back by id and text."""
    (mark,) = _named(docs, "_print")
    named = docs.withColumn(mark, _print())
    found = decontaminate.contaminated_pairs(named, read(spark, sf_dir, "benchmark"), key=mark)
    gone = materialise(found.select(F.col("doc_id").alias(mark)).distinct())
    return named.join(gone, mark, "left_anti").select(*docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words and copies that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal),
    ("mixing", mix_sources),
]

#: Stage 2 needs closures and stage 4 a trained model, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each reads what the last wrote."""
    folder = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
