"""Token counts through a digest cache.

The cache is a Parquet table (digest, tokenizer, n_tokens) keyed by the SHA-256 of the normalised content and by a digest of
the tokenizer's file and library version. A run reduces its texts to distinct digests, drops those the cache
knows, encodes the rest once each and appends their counts; then all documents join the cache. The content is
normalised only as far as the tokenizer is sure not to see it: null becomes empty.

Each distinct text crosses one shuffle; a text that many rows share is reduced before it. Documents join on narrow rows, which
adaptive execution can split for a hot digest. An append is committed whole or not at all, and counts don't depend on who
wrote them, so a repeated or lost task changes nothing; double appends by concurrent runs are reduced on reading.

Defined cases: null text is empty and has no tokens. A very long text is encoded whole, in a call of its own; it must fit a row.
Repeated rows each appear in the result, and rows that share a doc_id are counted each by its text. An empty table gives an
empty result. Special strings inside texts are handled as the library does by default. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import digest, read_table, staged, text_or_empty

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Characters that one call of the library gets, about.
CALL_CHARS = 500_000


def tokenizer_version(file: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    if file.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(file, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def counter(file: str):
    """A function from texts to token counts, without added special tokens, truncation or padding."""
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(file)
    model.no_truncation()
    model.no_padding()
    encode = getattr(model, "encode_batch_fast", model.encode_batch)
    return lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]


def calls(texts: list[str], limit: int = CALL_CHARS) -> Iterator[list[str]]:
    """The texts in runs of about `limit` characters; a longer text is a run of its own."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > limit:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def count_misses(misses: DataFrame, file: str, version: str) -> DataFrame:
    """(digest, tokenizer, n_tokens) of (digest, text) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(file)
        for b in batches:
            n = [x for run in calls(b.column("text").to_pylist()) for x in tokens(run)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(count, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache: str, file: str, text: str = "text") -> DataFrame:
    """doc_id, digest, n_bytes, n_tokens per row of `docs`; the cache at path `cache` gains what was missing."""
    spark, version = docs.sparkSession, tokenizer_version(file)
    content = text_or_empty(text)
    keyed = docs.select("doc_id", digest(content).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    misses = docs.select(digest(content).alias("digest"), content.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    known = read_table(spark, cache, CACHE_SCHEMA)
    if known is not None:
        misses = misses.join(known.filter(F.col("tokenizer") == version), "digest", "left_anti")
    count_misses(misses, file, version).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    # written first, so that the join has two plain exchanges and a hot digest can be split
    counts = staged(stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(counts, "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
