"""A store of the digests of all records seen so far: what a new run brings is looked up without reading the store whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.ordering import first_row
from canopy.session import cut
from canopy.sources import versions

BUCKETS = 64        # folders that digests are spread over; fixed for the life of a store
BITS = 1 << 24      # bits of a bucket's Bloom filter, in segments of 2^15; only segments with a bit are rows
HASHES = 4
MERGE = 8           # folders of one bucket at which a run that adds to it rewrites them as one
SEGMENT = 1 << 15   # bits that one bitmap of Spark's bitmap functions holds


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def _bits(keys: DataFrame, bits: int) -> DataFrame:
    """keys with one row per hash: the segment and the bit of it that the key sets."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(bits)) for i in range(HASHES)])).alias("at")
    return keys.select("*", at).withColumn("segment", F.floor(F.col("at") / SEGMENT).cast("int")).withColumn("bit", (F.col("at") % SEGMENT).cast("long")).drop("at")


def _filters(keys: DataFrame, bits: int) -> DataFrame:
    return _bits(keys, bits).groupBy("bucket", "segment").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _maybe(keys: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """(key, bucket) of the keys whose bits are all set: the only ones that can be in the store."""
    is_set = F.expr("shiftright(cast(conv(hex(substring(bitmap, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    merged = filters.groupBy("bucket", "segment").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    hit = _bits(keys.select("key", "bucket"), bits).join(merged, ["bucket", "segment"]).filter(is_set)
    return hit.groupBy("key", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") == HASHES).select("key", "bucket")


def _read(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def take(records: DataFrame, key: Column, path: str, run: int, order: list | None = None, buckets: int = BUCKETS, bits: int = BITS) -> tuple[DataFrame, dict]:
    """(the first record of every key that no earlier run brought, what was read and written).

    run numbers the runs, ascending; a run that is repeated, after a failure or not, gives the same records again and leaves the
    store as it was, as it is compared with the runs before it only. order chooses among records of one key (default: any). Records
    with a null key are no records. A column key of the records is replaced by the key.

    The store has digests in folders by bucket of their hash, and one Bloom filter per bucket in rows of bitmaps. A run reads the
    filters' bitmaps that its keys point at; keys with an unset bit are new, and only buckets with other keys are opened. New digests
    are added as new folders; a bucket of MERGE folders that gets more is rewritten as one. The manifest that names the folders is
    published last, so a lost run leaves nothing that counts. Both limits are on files, not on keys.
    """
    spark = records.sparkSession
    before = versions.latest(spark, path, before=run)
    state = before[1] if before else {"buckets": buckets, "bits": bits, "digests": {}, "filters": []}
    buckets, bits = state["buckets"], state["bits"]
    keyed = records.withColumn("key", key).filter("key is not null")
    firsts = first_row(keyed, ["key"], order) if order else keyed.dropDuplicates(["key"])
    firsts = cut(firsts.withColumn("_bucket", _bucket(buckets)), "firsts")
    keys = firsts.select("key", F.col("_bucket").alias("bucket"))
    kind = keys.schema["key"].dataType.simpleString()

    filters = _read(spark, state["filters"], "bucket int, segment int, bitmap binary")
    maybe = cut(_maybe(keys, filters, bits), "maybe")
    opened = sorted(r["bucket"] for r in maybe.select("bucket").distinct().collect())
    folders = [f for b in opened for f in state["digests"].get(str(b), [])]
    seen = _read(spark, folders, f"key {kind}").join(maybe.select("key"), "key", "left_semi")
    fresh = cut(firsts.join(seen, "key", "left_anti"), "fresh")

    own = f"run-{run:012d}-{uuid.uuid4().hex[:8]}"
    added = fresh.select("key", F.col("_bucket").alias("bucket"))
    touched = sorted(r["bucket"] for r in added.select("bucket").distinct().collect())
    full = [b for b in touched if len(state["digests"].get(str(b), [])) >= MERGE]
    digests = {b: list(f) for b, f in state["digests"].items()}
    if full:
        old = _read(spark, [f for b in full for f in digests[str(b)]], f"key {kind}").withColumn("bucket", _bucket(buckets))
        added = added.unionByName(old.select("key", "bucket"))
    added.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/digests/{own}")
    for b in touched:
        digests[str(b)] = [*([] if b in full else digests.get(str(b), [])), f"{path}/digests/{own}/bucket={b}"]
    filters_now = list(state["filters"])
    if touched:
        new = _filters(fresh.select("key", F.col("_bucket").alias("bucket")), bits)
        if len(filters_now) >= MERGE:
            new = new.unionByName(filters).groupBy("bucket", "segment").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            filters_now = []
        new.write.parquet(f"{path}/filters/{own}")
        filters_now.append(f"{path}/filters/{own}")
    versions.publish(spark, path, run, {"buckets": buckets, "bits": bits, "digests": digests, "filters": filters_now})
    return fresh.drop("_bucket"), {"opened": opened, "folders": folders, "touched": touched, "merged": full}
