"""Token counts through a digest cache.

A text's content digest (SHA-256 of its UTF-8 bytes; null is empty) and a tokenizer's version digest (SHA-256 of its file and
of how it is called) key the stored counts. Counting joins documents' digests to the cache, encodes each distinct miss once,
appends the new counts, and joins them back. Content is normalised only where no tokenizer can tell the difference (null to
empty): any Unicode or white-space normalisation would change counts.

Defined results: every row gets a count, repeated rows and doc_ids too; empty and null texts have 0 bytes and the count the
library gives for an empty string. Texts of any length are encoded whole. An empty table gives no rows.

Recovery: counts are written by Spark's committer, so a lost executor or a retried task leaves neither gaps nor repeats;
two writers may both append a count, and readers take one of them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled

SCHEMA = "content string, tokenizer string, n_tokens long"
#: Texts of so many characters in all are encoded in one call.
CALL_CHARS = 1 << 20


def tokenizer_digest(path: str) -> str:
    h = hashlib.sha256(b"no special tokens, no truncation, library default:")
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


_loaded: dict[str, object] = {}


def _counter(path: str):
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    return _loaded[path]


def _encode(path: str):
    def run(batches):
        import pyarrow as pa

        count = _counter(path)
        for batch in batches:
            texts, out, call, chars = batch.column("text"), [], [], 0
            for i in range(len(texts)):
                call.append(texts[i].as_py() or "")
                chars += len(call[-1])
                if chars >= CALL_CHARS or i == len(texts) - 1:
                    out += count(call)
                    call, chars = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(out, pa.int64())], names=["content", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs; `cache` is a folder of stored counts, made if missing."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    cache = cache or scratch.path("cache")
    version = tokenizer_digest(path)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("content"))
    narrow = scratch.save(keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    stored = _stored(spark, cache, version)
    owners = narrow.groupBy("content").agg(F.min("doc_id").alias("_owner")).join(stored, "content", "left_anti").select(F.col("content").alias("_content"), "_owner")
    # one document stands for each distinct miss; doc_id spreads the rows, so a text that many documents share stays cheap
    misses = keyed.join(owners, F.col("doc_id").eqNullSafe(F.col("_owner")) & (F.col("content") == F.col("_content")), "left_semi")
    fresh = misses.select("content", "text").mapInArrow(_encode(path), "content string, n_tokens long").dropDuplicates(["content"])  # of rows repeated whole
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = _stored(spark, cache, version)
    joined = narrow.join(small_or_shuffled(counts), "content")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer version, one row each."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA).select("content", "n_tokens")
    return spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
