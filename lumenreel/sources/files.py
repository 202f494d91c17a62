"""Files as tables: JSON, JSON lines, text, listings, chunk exports, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenreel.functions import text as T
from lumenreel.operators.assets import listing_order
from lumenreel.tables import first_of_key


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """Rows of JSON files: one value a file, or one a line with blank lines skipped. A path without files gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=not lines)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files, with replacement marks for what isn't UTF-8. A path without files gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, value string")
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.col("content").cast("string").alias("value"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that Spark reads it with."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def listing(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """(name, size, modified, kind) of the files below a folder with one of the suffixes, in the order of a listing; contents are not read, and files without any are passed over by the source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_replace(F.substring_index("path", folder.rstrip("/") + "/", -1), "^/+", "")
    rows = files.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.where(T.suffix(F.col("name")).isin(*suffixes)).withColumn("kind", T.suffix_class(F.col("name")))
    return rows.orderBy(*listing_order("name", "size", {s: k for k, s in enumerate(suffixes)}))


def valid_inputs(files: DataFrame, name: str, suffixes: list[str]) -> DataFrame:
    """`files` with `valid`: whether the suffix is allowed."""
    return files.withColumn("valid", T.suffix(F.col(name)).isin(*suffixes))


def write_chunks(cues: DataFrame, path: str, chunk: str = "chunk") -> None:
    """One folder a chunk."""
    cues.repartition(chunk).write.mode("overwrite").partitionBy(chunk).parquet(path)


def snapshots(templates: DataFrame, key: list[str], body: str, order: list[str]) -> DataFrame:
    """The first of the templates of each key with the same content, with their hash and its first 12 digits."""
    rows = templates.withColumn("hash", T.content_hash(F.col(body))).withColumn("prefix", F.substring("hash", 1, 12))
    return first_of_key(rows, [*key, "prefix"], [F.col(c) for c in order])


def resolve_path(folder: str, c):
    """A relative path below a folder; null for one that leads out of it."""
    clean = F.regexp_replace(F.trim(c), r"^(?:\./)+", "")
    out = F.startswith(clean, F.lit("/")) | F.regexp_like(clean, F.lit(r"(?:^|/)\.\.(?:/|$)"))
    return F.when(~out, F.concat(F.lit(folder.rstrip("/") + "/"), clean))


def same_format(audio: DataFrame, group: str, params: list[str]) -> DataFrame:
    """(group, parts, same): whether the parts that are to be joined agree in all their parameters."""
    return audio.groupBy(group).agg(F.count("*").alias("parts"), (F.count_distinct(F.struct(*params)) == 1).alias("same"))
