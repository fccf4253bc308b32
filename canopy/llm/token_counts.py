"""Token counts with a digest cache."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.tokenizer import chunks, loaded, tokenizer_source

BATCH_BYTES = 4_000_000


def _read_cache(spark, path: str, version: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    kept = spark.read.schema("digest binary, version string, n_tokens long").parquet(path)
    return kept.filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of its whole text in column out (replaced if it exists).

    Content is normalised as far as the count allows: null is the empty text, nothing else is changed. Each content
    digest (SHA-256) is joined, with the digest of the tokenizer file, to the counts stored under the folder cache; only
    distinct contents without a stored count are encoded, and their counts are appended to the folder.

    Equal contents, however many, are one miss: copies are combined before the shuffle. Empty tables give an empty
    result; repeated rows and null ids are kept as they are; special strings in texts count as the library takes them.
    A job that dies leaves the cache without its counts or with all of them; counts stored twice are harmless.
    """
    spark = docs.sparkSession
    source, version = tokenizer_source(tokenizer)
    shipped = spark.sparkContext.broadcast(source)
    content = F.coalesce(F.col(text), F.lit(""))
    contents = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    stored = _read_cache(spark, cache, version)
    misses = contents if stored is None else contents.join(stored, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shipped.value, version)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            counts = []
            for a, b in chunks(sizes, BATCH_BYTES):
                counts += pieces.count(batch.column(1).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    counted = misses.dropDuplicates(["digest"]).mapInArrow(encode, "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    # The stored digests are unique after this, as the table is read back with one count per digest.
    known = _read_cache(spark, cache, version).withColumnsRenamed({"digest": "_digest", "n_tokens": "_count"})
    keyed = docs.drop(out).withColumn("_key", F.unhex(F.sha2(content, 256)))
    return keyed.join(known, F.col("_key") == F.col("_digest"), "left").withColumn(out, F.col("_count")).drop("_key", "_digest", "_count")


def cache_folder(spark, name: str = "token-counts") -> str:
    """A fresh cache folder beside the session's other shared tables."""
    from canopy.session import run_dir

    return os.path.join(run_dir(spark, name), "counts")
