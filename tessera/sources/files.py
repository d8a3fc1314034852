"""File trees, snapshots, manifests, and the sinks that write results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import file_kind, secret_like
from tessera.operators.scans import running_total
from tessera.staging import stage


def discover(spark: SparkSession, root: str, include: str = r".*", ignore: str = r"(^|/)(\.git|node_modules|dist)/", max_files: int = 100_000, max_bytes: int = 1 << 40) -> DataFrame:
    """(path, bytes, kind, skipped): files under root; skipped names the rule that leaves a file out.

    Only names and lengths are read. The caps count and sum, in path order and by scans in parts, the files that no rule
    skipped; caps are a stated feature.
    """
    files = _under(spark, root).select("path", F.col("length").alias("bytes"))
    rule = F.when(F.col("path").rlike(ignore), "ignored").when(secret_like(F.col("path")), "secret").when(~F.col("path").rlike(include), "not_included")
    files = files.withColumn("skipped", rule)
    taken = F.when(F.col("skipped").isNull(), 1).otherwise(0).cast("long")
    files = running_total(files, [], ["path"], taken, "_n")
    files = running_total(files, [], ["path"], taken * F.col("bytes"), "_b")
    capped = F.when(F.col("skipped").isNull() & ((F.col("_n") > max_files) | (F.col("_b") > max_bytes)), "cap").otherwise(F.col("skipped"))
    return files.select("path", "bytes", file_kind(F.col("path")).alias("kind"), capped.alias("skipped"))


def _under(spark: SparkSession, root: str) -> DataFrame:
    """The files under root with paths relative to it."""
    base = root.rstrip("/").replace("file://", "")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + base.replace(".", r"\.") + "/?", "")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("path", path)


def file_nodes(files: DataFrame, root: str) -> DataFrame:
    """(path, bytes, lines, digest, kind) of discovered files. Contents become lines and digest in the task that reads
    them, so only these are joined."""
    text = F.decode("content", "UTF-8")
    read = _under(files.sparkSession, root).select("path", F.size(F.split(text, "\n", -1)).alias("lines"), F.sha2("content", 256).alias("digest"))
    return files.where("skipped is null").join(read, "path").select("path", "bytes", "lines", "digest", "kind")


def fingerprint(snapshot: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """One row: the SHA-256 over the sorted (path, digest) list of one snapshot.

    A two-level digest: 4096 buckets are hashed in parallel, and the sorted bucket digests are hashed at the end.
    """
    bucket = F.pmod(F.xxhash64(path), F.lit(4096))
    parts = snapshot.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\0", path, digest))), "\n"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("b").cast("string"), "d"))), "\n"), 256).alias("fingerprint"))


def strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON files with a declared schema; malformed input fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """(path, name, script, command) of package manifests (path, body)."""
    body = F.from_json("body", "name string, packageManager string, scripts map<string,string>")
    return manifests.withColumn("m", body).select("path", F.col("m.name").alias("name"), F.explode_outer("m.scripts").alias("script", "command"))


def append_events(events: DataFrame, target: str) -> None:
    """Append events to the log; ids are checked by readers, never rewritten."""
    events.write.mode("append").parquet(target)


def next_event_ids(log: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """new with event_id following the log's largest id, in the given order, gapless.

    Rows are numbered inside range partitions and offset by the counts of the partitions before, so no task
    sorts all rows.
    """
    spark = new.sparkSession
    first = log.agg(F.coalesce(F.max("event_id"), F.lit(0).cast("bigint"))).first()[0]
    parts = new.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    parts = stage(parts, "events")
    counts = {r[0]: r[1] for r in parts.groupBy("_p").count().collect()}
    offsets, total = [], first
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    offset = spark.createDataFrame(offsets, "_p int, _o bigint")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parts.join(F.broadcast(offset), "_p").withColumn("event_id", F.col("_o") + place).drop("_p", "_o")


def envelope(rows: DataFrame, max_bytes: int) -> DataFrame:
    """One row (status, complete, n, bytes): the whole result is withheld if its JSON is over the byte bound."""
    sized = rows.select(F.octet_length(F.to_json(F.struct(*rows.columns))).alias("b"))
    out = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0).cast("bigint")).alias("bytes"))
    over = F.col("bytes") > max_bytes
    return out.select(F.when(over, "withheld").otherwise("ok").alias("status"), (~over).alias("complete"), "n", "bytes")


def json_lines(rows: DataFrame, target: str) -> None:
    """NDJSON sink: one object a line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(target)


def atomic_json(rows: DataFrame, target: str) -> None:
    """JSON cache that readers see whole or not at all: written beside the target, then renamed over it."""
    spark = rows.sparkSession
    aside = f"{target}.{uuid.uuid4().hex}"
    rows.write.json(aside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(aside)
    system = old.getFileSystem(conf)
    system.delete(old, True)
    if not system.rename(new, old):
        raise OSError(f"{aside} could not be renamed to {target}")


def fitting_scopes(rows: DataFrame, scope: str, columns: list[str], max_bytes: int) -> DataFrame:
    """rows of the scopes kept when whole scopes are dropped from the end (in name order) until the JSON fits."""
    size = F.octet_length(F.to_json(F.struct(*columns)))
    sizes = rows.groupBy(scope).agg(F.sum(size).alias("_bytes"))
    kept = running_total(sizes, [], [scope], F.col("_bytes"), "_sum").where(F.col("_sum") <= max_bytes).select(scope)
    return rows.join(kept, scope, "left_semi")
