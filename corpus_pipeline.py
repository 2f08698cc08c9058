"""From raw documents to token ids: the stages of the corpus pipeline, in order.

Each stage takes the rows that the one before it wrote and returns rows of the same columns; the last returns ids.
Null texts are empty; rows without an id go through every stage, but can stand for no group of copies that has an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import exact_dedup, mixing, near_dedup, pieces, quality
from ledgerlake.llm.queries import id_crc
from ledgerlake.llm.words import row_key, whole_row
from ledgerlake.session import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on the labelled two thirds that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = quality.model_of(docs, labels, id_crc() % 3 == 1)
    # Columns go by place, so that no name of theirs meets that of the score.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    scored = quality.with_scores(numbered, model, "score", f"c{docs.columns.index('text')}")
    return scored.where("score >= 0.5").drop("score").toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one with the smallest id.

    The decision is for an id and its text: another text of the same id stays if it is kept itself, and a row without an id goes if
    an equal row has one. Of rows that repeat an id, or its absence, and the text one stays: that of the smallest hash of all columns.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = cut(exact_dedup.exact_duplicates(docs).select("doc_id", "kept", "text_sha256"))
    rows = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("sha"), *row_key(docs), whole_row(docs).alias("row"))
    if not found.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        # Copies shrink per task, so that no key of the join below has many rows.
        rows = rows.groupBy("doc_id", "sha").agg(F.min_by("row", F.struct("key_1", "key_2")).alias("row"))
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha"))
    return rows.join(gone, same, "left_anti").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Texts of one id are one document and go or stay together; a row without an id is in no group and stays, as the operator marks it.
    """
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, round_trip, ids: the piece ids of each row, and whether they decode to its text."""
    import public_tokenizers

    model = pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = pieces.encoded(docs, model, check=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), (F.col("round_trip") & ~F.col("markers")).alias("round_trip"), "ids")


STAGES = [
    ("quality", good_quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]
#: The classifier, set similarity over hashed shingles and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage reads what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
