"""A training corpus from documents: toxicity, line dedup, near-duplicate documents, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents, also where their names are those of a stage's own columns. Stages are joined by tables: run() writes each
result to the shared folder and reads it again.

In every stage a null text counts as empty, ties are broken by id and then by content, a repeated row is kept or
dropped with its like, and an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.llm.common import Scratch
from relmill.llm.jaccard_join import jaccard_groups
from relmill.llm.line_dedup import line_dedup
from relmill.llm.mixing import in_order, mix
from relmill.llm.packing import pack
from relmill.llm.queries import SOURCE_WEIGHTS
from relmill.llm.toxicity import fold, scored_rows, train

TOXIC = 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity score reaches TOXIC. Null and empty texts score by the bias, a row with a null
    id is judged like any other, and without labels of both classes all documents stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 3) != 1)
    clean = scored_rows(docs, train(docs, labels), docs.columns).where(F.col("score") < TOXIC)
    return clean.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts fuzzy duplicate lines, all but the first of each group; n_chars follows the text. Documents left
    without a letter or digit go, as all their lines are kept elsewhere; those that never had one stay, null texts too.
    Rows with a null id stay whole. Of repeated rows the first lines are the same, so they stay or go together."""
    said = F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    out = line_dedup(docs.withColumn("_said", said), min_words=1).where(~F.col("_said") | said).drop("_said")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near-duplicate documents, the one with the smallest id. Texts without a word are alike
    to none, so empty and null ones stay, as do rows with a null id. All rows of an id stay or go together."""
    gone = jaccard_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows in the order of their slots. Sources that are null or have no weight follow
    the others."""
    return in_order(docs, SOURCE_WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens, numbered in the order of the
    mixture. Files read again keep no order, so slots are worked out from the documents, as in mixing_stage. A null or
    empty text is one piece, its closing token; a repeated row is packed again, and a null id stays null."""
    import public_tokenizers

    slots = mix(docs.select("doc_id", "source", "text"), SOURCE_WEIGHTS)
    slots = slots.select("doc_id", "text", (F.shiftleft("_slot", 32) + F.col("_place")).alias("_at"))
    return pack(slots, public_tokenizers.path("word_bpe_49k.json"), order_col="_at")


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("ngram_jaccard", jaccard_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL cannot express the trained model, SimHash groups or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, scratch.store(stage(spark, docs, sf_dir), name)
        scratch.drop(last)  # a stage's result goes once the next one has its own
    return STAGES[-1][1](spark, docs, sf_dir)
