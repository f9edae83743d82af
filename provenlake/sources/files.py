"""Reading transcript, label and session files.

A transcript file is one row until it is split into numbered lines, as a line number needs
all lines before it; files spread over the tasks.  Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, seq, line_id, raw) of JSON-lines files; the session is the file's name without ending, lines count from 1, blank ones too."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.jsonl?$", "").alias("session"), "value")
    lines = whole.select("session", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("pos", "raw"))
    return lines.select("session", (F.col("pos") + 1).cast("long").alias("seq"), (F.col("pos") + 1).cast("long").alias("line_id"), "raw")


def transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """(session, sha256, bytes) of the files themselves."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("_metadata.file_name", r"\.jsonl?$", "").alias("session"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels or candidates, one JSON object a line; bad lines are left out."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def session_documents(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, saved_at, doc) of session documents, one JSON file each."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("session_id"), F.col("_metadata.file_modification_time").alias("saved_at"), F.col("value").alias("doc"))
