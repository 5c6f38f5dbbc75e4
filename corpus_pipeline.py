"""A cleaning pipeline over ``documents``: each stage is written as Parquet and read again by the next.

1. toxicity: documents that the lexicon model scores 0.7 or more go;
2. near duplicates: of each group of similar documents the one with the smallest id stays;
3. decontamination: documents of which a twentieth of the words are benchmark text go;
4. secrets: they are masked in the texts that stay;
5. tokens: every text is encoded, and decoded again as a proof.

Stages 1 to 4 return the columns of ``documents``. Null texts count as empty, and
documents without words pass every filter.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import bpe, decontaminate, ngram_join, secret_scan, toxicity
from barspark.llm.common import Stage, fresh, small
from barspark.llm.queries import BPE_FILE, TOXIC, table, toxicity_model

Step = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Words in an n-gram, and the least similarity in percent, of near duplicates.
SHINGLE, SIMILAR = 5, 80


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; the model learns from labels outside the held-out third."""
    model = toxicity_model(spark, docs, sf_dir)
    return toxicity.score(docs, model, out="toxic_score").filter(F.col("toxic_score") < TOXIC).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.deduplicate(docs, size=SHINGLE, percent=SIMILAR)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't made of benchmark text to a twentieth or more; each row is judged by itself, whatever its id."""
    stage, row = Stage(spark, "contaminated"), fresh(docs, "row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    judged = decontaminate.contamination(numbered, table(spark, sf_dir, "benchmark"), id=row)
    bad = judged.filter(decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit"))).select(row)
    return numbered.join(small(stage(bad)), row, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked; ``n_chars`` follows the new text."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    done = bpe.round_trip(docs, public_tokenizers.path(BPE_FILE))
    return done.select(
        "doc_id", "lang", "source", "text", "n_chars", "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.col("text")).alias("reversible"),
    )


STAGES: list[tuple[str, Step]] = [
    ("toxicity", keep_civil),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("secrets", mask_secrets),
    ("tokens", tokens),
]

#: The toxicity model and the tokenizer have no SQL form: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they hand on is staged in the shared folder."""
    stage = Stage(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
