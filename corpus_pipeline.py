"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
documents. ORACLE_SQL is None: a trained score, set similarity joins and fingerprints aren't SQL; tests/llm holds each stage against
a brute-force version.

Defined results, for all stages: rows are judged one by one, never by doc_id alone, so rows of null doc_id and rows that repeat one take
part like any other; null and empty texts stay (they score as empty, are near to nothing, hold no item and no personal data); ties in a
group of near copies go to the least doc_id, then to the least digest of the text; extra columns, whatever their names, are carried
along (the last stage adds `copy` and `shuffle_key` and replaces columns of these names); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, mixing, ngram_join, pii, toxicity
from gridloom.llm.common import Scratch, discard_scratch, fresh, scratch_made

TOXIC_FROM = 0.7
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; trained on the labelled rows of docs that aren't held out."""
    model = toxicity.train(toxicity.labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = fresh(docs, "toxicity")
    return toxicity.score(docs, model, score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8): the one of least doc_id."""
    return ngram_join.one_of_each_group(docs, 5, 80, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window is like a benchmark item."""
    return decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text replaced by [EMAIL], [IP], [CARD] or [PHONE] and n_chars counted anew."""
    redacted = pii.redact_documents(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns]) if "n_chars" in docs.columns else redacted


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights and shuffled, with `copy` and `shuffle_key`."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal_data", redact_personal_data), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written as Parquet and read again as the next one's; what a stage leaves goes then."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = scratch_made()
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        discard_scratch(spark, since)
        if before:
            scratch.drop(before)
        before = name
    return docs
