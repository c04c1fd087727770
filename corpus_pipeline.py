"""A corpus pipeline: quality, language, line dedup, near-dedup, packing. Part of the subpackage `llm`.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its result is written as
Parquet and read again for the next. All but the last return the columns of `docs`, whatever else those may be and
whatever their names. Stages are queries, so they lower the session's Arrow batches to what texts need.

Nulls and edges, in every stage: a null text counts as empty, a null id is an id of its own, and an empty table gives an
empty result. Quality: empty texts get the curve's value, which rejects or keeps all of them alike. Language: texts without
letters, empty ones too, go. Lines: an empty text stays; of rows that share id and text all or none are cut. Near-dedup: of
rows that repeat, with their id or without, one stays; texts without words are one group; ties go to the smallest id.
Packing: every row is packed, an empty one as its end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import linededup, neardup, packing, quality
from millrace.llm.common import discard, read_texts, small_batches, written
from millrace.llm.queries import fit_quality, identify_documents, tokenizer_file, tokenizer_pattern


def _aliased(docs: DataFrame) -> DataFrame:
    """`docs` with names that no operator's own columns can clash with."""
    small_batches(docs.sparkSession)
    return docs.toDF(*(c if c in ("doc_id", "text", "lang", "source") else f"__{k}_{c}" for k, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good."""
    own = _aliased(docs)
    scored = quality.score(own, fit_quality(docs, sf_dir), own.columns)
    return scored.where("predicted = 1").select(own.columns).toDF(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence."""
    own = _aliased(docs)
    return identify_documents(own, own.columns).where("accepted").select(own.columns).toDF(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; one that has nothing else goes. n_chars follows the text."""
    own = _aliased(docs)
    done = linededup.dedup_lines(own).where((F.col("n_deleted") == 0) | (F.trim("text") != "")).select(own.columns).toDF(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest id: SimHash links, and others, with a similarity of 0.8 of five-word runs."""
    own = _aliased(docs)
    return neardup.representatives(own).select(own.columns).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their ids."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern(), with_ids=True)


STAGES = [("quality", quality_stage), ("language", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: SQL can't express a compression classifier, nor the stages after it; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted as soon as the next one has read it (packing, which is lazy, reads the last)."""
    docs, last = read_texts(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
