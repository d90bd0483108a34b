"""The corpus pipeline: documents without toxic ones and near duplicates, without personal data, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import mixing, near_dedup, packing, pii, toxicity
from parley.llm.common import Scratch, let_go, read_table, small
from parley.llm.queries import tokenizer_path

#: A document goes from this score on.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores under TOXIC; the model learns from the labels of these documents.

    Rows that share an id and a text have one score; null and empty texts stay.
    """
    let_go(spark)
    model = toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxic_score(spark, F.col("text"), model) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 on five-word shingles reach: the one with the smallest id.

    Texts without words and rows without an id stay. Of rows that agree in id and text, one stays. Different texts of
    one id are documents of their own, in order of their hashes.
    """
    let_go(spark)
    scratch = Scratch(spark)
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").alias("part_id"), F.xxhash64("text").alias("part_text"))
    if not hashed.groupBy("part_id").agg(F.min("part_text").alias("a"), F.max("part_text").alias("b")).where("a < b").isEmpty():
        return once(spark, _without_copies(scratch, docs, hashed))
    groups = near_dedup.near_duplicates(spark, docs, shingle=5, percent=80)
    gone = scratch.save(groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    left = docs.alias("d").join(small(gone, gone.count()).alias("g"), F.col("d.doc_id") == F.col("g.gone_id"), "left_anti")
    return once(spark, left)


def _without_copies(scratch: Scratch, docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """``docs`` without near duplicates, each pair of id and text hash under a number of its own that grows with the id."""
    spark = scratch.spark
    parts = scratch.save(hashed.distinct().orderBy("part_id", "part_text").withColumn("part", F.monotonically_increasing_id()), "parts")
    same = (F.col("d.doc_id") == F.col("p.part_id")) & (F.xxhash64("d.text") == F.col("p.part_text"))
    numbered = docs.alias("d").join(parts.alias("p"), same).select(F.col("p.part").alias("doc_id"), F.col("d.text").alias("text"))
    groups = near_dedup.near_duplicates(spark, scratch.save(numbered, "numbered"), shingle=5, percent=80)
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias("part")).distinct()
    gone = scratch.save(parts.join(dropped, "part").select("part_id", "part_text"), "gone_parts")
    return docs.alias("d").join(small(gone, gone.count()).alias("p"), same, "left_anti")


def once(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of those that agree in id and text. Only ids and hashes are shuffled to find them."""
    pairs = docs.where("doc_id is not null").select(F.col("doc_id").alias("again_id"), F.xxhash64("text").alias("again_text"))
    again = Scratch(spark).save(pairs.groupBy("again_id", "again_text").count().where("count > 1").select("again_id", "again_text"), "again")
    n = again.count()
    if not n:
        return docs
    same = (F.col("d.doc_id") == F.col("g.again_id")) & (F.xxhash64("d.text") == F.col("g.again_text"))
    alone = docs.alias("d").join(small(again, n).alias("g"), same, "left_anti")
    row = F.struct(*(F.col(c) for c in docs.columns))
    repeated = docs.alias("d").join(small(again, n).alias("g"), same, "left_semi").select(row.alias("row"))
    # as JSON a row can be compared whatever its columns' types are
    first = repeated.groupBy("row.doc_id", F.xxhash64("row.text")).agg(F.min_by("row", F.to_json("row")).alias("first_row"))
    return alone.unionByName(first.select(*(F.col(f"first_row.{c}").alias(c) for c in docs.columns)))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind; ``n_chars`` is that of the new text."""
    let_go(spark)
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated so that a source's share follows the square root of its size, in random order."""
    let_go(spark)
    own = [c for c in docs.columns if c.lower() in mixing.ADDED]
    if not own:
        return mixing.mix(docs).select(*docs.columns)
    held = "held_" + "_".join(docs.columns)  # longer than any column's name
    apart = docs.select(*(c for c in docs.columns if c not in own), F.struct(*own).alias(held))
    return mixing.mix(apart).select(*(F.col(f"{held}.{c}") if c in own else F.col(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 ids."""
    let_go(spark)
    pieces = packing.pack(spark, docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Scores and token ids are beyond SQL; tests/llm compares each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``. Each stage's rows are written to the shared folder."""
    scratch, docs, before = Scratch(spark), read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        table = name.replace(" ", "_")
        docs = scratch.save(stage(spark, docs, sf_dir), table)
        if before:
            scratch.drop(before)
        before = table
    return docs
