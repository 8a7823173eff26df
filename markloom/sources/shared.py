"""Tables in the folder that driver and executors share, and readers of wiki inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="markloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/markloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def template_directory(spark: SparkSession, path: str) -> DataFrame:
    """title, text from a folder of .wiki or .txt files; percent-decoded names, U+A789 for a colon."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.input_file_name().alias("_file"))
    name = F.regexp_replace(F.regexp_extract("_file", r"([^/]*)$", 1), r"\.(?:wiki|txt)$", "")
    decoded = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return files.select(F.replace(F.coalesce(F.try_url_decode(decoded), decoded), F.lit("꞉"), F.lit(":")).alias("title"), "text")


def site_of(url):
    """(site, host) of a Wikimedia-style host name column."""
    host = F.regexp_extract(url, r"^(?:https?:)?//([^/]+)", 1)
    label, family = F.regexp_extract(host, r"^([a-z-]+)\.", 1), F.regexp_extract(host, r"([a-z]+)\.org$", 1)
    short = F.when(family == "wikipedia", "wiki").otherwise(family)
    return F.struct(F.concat(F.replace(label, F.lit("-"), F.lit("_")), short).alias("site"), host.alias("host"))
