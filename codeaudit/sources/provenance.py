"""Provenance logs and manifests, from files to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeaudit.session import checkpoint

# Blocks whose starts (some 200 bytes each) are sent to every task; more of them meet the lines in a shuffle.
BROADCAST_BLOCKS = 100_000


def number_lines(lines: DataFrame) -> DataFrame:
    """Add `line_no`, exact for every file, to lines(file, block, place, ...) of the text reader.

    A block is the part of a file that one task reads; its lines come in the order
    of `place`, without a gap.  The first pass counts the lines of every block and
    sums the counts of the blocks before; the second adds each line's place in its block.
    """
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Stored, so that both passes agree on it; one row for each block.
    starts = checkpoint(blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    if starts.count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    inside = F.col("place") - F.col("first_place")
    number = F.when((inside >= 0) & (inside < F.col("n")), F.col("before") + inside + 1).otherwise(
        F.raise_error(F.concat(F.lit("a log changed while it was read: "), F.col("file"))))
    return lines.join(starts, ["file", "block"]).withColumn("line_no", number.cast("long")).drop("n", "before", "first_place")


def read_provenance_log(spark: SparkSession, path: str | list[str], store: Column | None = None) -> DataFrame:
    """Log lines (store_id, line_no, raw) with their exact line numbers; blank lines are kept.

    Files are read in parts by as many tasks as their size gives; a log has no
    largest size.  A line ends at a line feed only, and one at the end of the file
    begins no further line.  `store` is a column over `file`, the path of the log;
    by default the folder a log is in.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))
    owner = store if store is not None else F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    return number_lines(lines).select(owner.alias("store_id"), "line_no", "raw")


def read_manifests(spark: SparkSession, path: str, kind: str, store: Column | None = None) -> DataFrame:
    """Texts of `<store>/manifests/<kind>/<name>/<version>.json`: (store_id, name, version, raw)."""
    pattern = rf"([^/]+)/manifests/{kind}/([^/]+)/([^/]+)\.json$"
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    where = F.col("_metadata.file_path")
    owner = store if store is not None else F.regexp_extract(where, pattern, 1)
    return text.filter(where.rlike(pattern)).select(
        owner.alias("store_id"), F.regexp_extract(where, pattern, 2).alias("name"),
        F.regexp_extract(where, pattern, 3).alias("version"), F.col("value").alias("raw"))


def explode_dataset_manifests(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw dataset manifests to (headers, files)."""
    schema = (
        "schema_version string, created_at string, actor struct<contributor:string,key_id:string>, "
        "file_count long, total_bytes long, merkle_root string, record_hash string, signature string, "
        "files array<struct<path:string,size:long,sha256:string>>, "
        "policy struct<extensions:array<string>,allowSymlinks:boolean,maxFileSize:long>")
    parsed = manifests.withColumn("_m", F.from_json("raw", schema))
    keys = ["store_id", "name", "version"]
    headers = parsed.select(
        *keys, "raw", "_m.schema_version", "_m.created_at", F.col("_m.actor.contributor").alias("contributor"),
        F.col("_m.actor.key_id").alias("key_id"), "_m.file_count", "_m.total_bytes", "_m.merkle_root",
        "_m.record_hash", "_m.signature", F.col("_m.policy.extensions").alias("extensions"),
        F.col("_m.policy.maxFileSize").alias("max_file_size"))
    files = parsed.select(*keys, F.explode("_m.files").alias("_f")).select(*keys, "_f.*")
    return headers, files
