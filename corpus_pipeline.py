"""The corpus pipeline: five stages over ``documents``, each on all that the stage
before kept.

Every stage but the last returns the columns of ``documents``.  ``run`` writes what
a stage returns to the shared folder and reads it back, so that a stage's lineage
ends at its input and a lost executor costs no more than one stage's tasks.

Defined results, in all stages: a null text is handled as an empty one (and is only
written anew as one by line_dedup); a row with a null doc_id is never a copy and
never in line for its lines, but is dropped like any other for toxicity; rows that
repeat a doc_id stay or go together, except in toxicity, where each row's own text
decides; an empty table passes through empty; columns beyond those of ``documents``
are carried along, whatever their names, by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, line_dedup, neardup, toxicity
from lodestone.llm.common import materialize, maybe_broadcast, table, tidy_driver


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    taken = {c.lower() for c in docs.columns}
    while name in taken or f"{name}_threshold" in taken:
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose score reaches their language's threshold.  A text without a
    word has no sign of toxicity and stays, whatever the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = _free(docs, "_tox")
    scored = toxicity.score(docs, model, out=out)
    wordless = ~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    return scored.filter((F.col(out) < F.col(f"{out}_threshold")) | wordless).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines from all documents but the first that holds them; n_chars
    follows where lines were dropped.  A null text becomes an empty one."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_ld_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates, by the measure of
    op4's contract: shingles of two words, 0.8 alike.  Wordless texts stay."""
    gone = materialize(neardup.near_duplicates(docs, shingle=2).filter("NOT kept").select("doc_id").distinct(), "neardup-gone")
    return docs.join(maybe_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of any benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), min_items=1)
    gone = materialize(found.filter("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(maybe_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of what is left."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: The trained classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        tidy_driver(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
