"""From raw documents to packed training sequences, one operator a stage.

Every stage works on all rows that the one before it kept. Between stages the rows are written as
Parquet into the shared folder and read again, so a lost executor costs a stage at most.

Defined cases: a null text counts as empty and passes every filter; a null id is no copy of anything
and is kept; of rows that share an id, the one with the smallest hash of its text is kept, whatever
partitions they lie in; very long texts are handled whole; columns that no stage reads are carried to
the packing stage under their own names, even where those clash with columns of an operator; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelake.llm import mixing, neardup, packing, secrets, toxicity
from pricelake.llm.common import WORD, written

#: SQL for the rows of run(); the stages cannot be written in it.
ORACLE_SQL = None
#: Ids that may be broadcast to drop documents (about 30 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000


#: Columns that stages read; others are carried under names that clash with nothing.
READ = ("doc_id", "text", "source", "lang", "n_chars")


def hidden(docs: DataFrame) -> DataFrame:
    """docs with every column that no stage reads under a name of its own."""
    return docs.toDF(*(c if c in READ else f"__extra{i}" for i, c in enumerate(docs.columns)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    plain = hidden(docs)
    net = toxicity.fitted(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(plain, net, plain.columns).where("predicted = 0").select(*plain.columns).toDF(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates, and of rows that share an id the first by the text's hash; a null id is shared by none."""
    groups = neardup.near_duplicates(docs)
    dropped = written(groups.where("NOT kept").select("doc_id").distinct(), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    ids = repeated.count()
    if not ids:
        return kept
    repeated = F.broadcast(repeated) if ids <= BROADCAST_IDS else repeated
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", F.to_json(F.struct(*docs.columns)))
    first = kept.join(repeated, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(first.drop("__nth")).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the text."""
    plain = hidden(docs)
    found = secrets.scanned(plain, plain.columns)
    masked = found.withColumn("text", secrets.redacted("text", "spans"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*plain.columns).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to meet the sources' targets; the document at a cut is shortened to the words taken."""
    plain = hidden(docs)
    mixed = mixing.mixed(plain, [c for c in plain.columns if c not in ("doc_id", "source")])
    copies = mixed.where("taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("__copy") - 1) * F.col("size"))
    short = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), 1), F.lit(1), words.cast("int")), " ")
    copies = copies.withColumn("text", F.when(words < F.col("size"), short).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return copies.select(*plain.columns).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
