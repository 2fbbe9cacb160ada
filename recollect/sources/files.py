"""File sources and sinks: JSON directories per persona, reports as JSON or CSV, relational tables over JDBC."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.runtime import shared_dir

MESSAGE = "array<struct<turn:int,role:string,content:string,agent_type:string>>"
#: The schema of a dialogue file.
DIALOGUES = (
    f"metadata struct<version:string>, sessions array<struct<session_id:bigint,persona_id:bigint,event_id:bigint,status:string,turn_count:int,messages:{MESSAGE},"
    "kp_count:int,created_at:string,persona_info:struct<type_name:string,gender:string>,event_info:struct<event:string,type:string,date:string>,noise_id:bigint,noise_family_id:bigint>>"
)


def persona_sessions(spark: SparkSession, root: str, file: str = "generated_dialogues.json", personas: list[int] | None = None, most: int | None = None, head: int | None = None) -> DataFrame:
    """Sessions of root/persona_<n>/eval/<file>, one row each, with persona and original_index.

    ``personas`` keeps these numbers, ``most`` the first in numeric order, ``head`` the first sessions of each.
    """
    df = spark.read.schema(DIALOGUES).json(f"{root}/persona_*/eval/{file}", multiLine=True)
    df = df.withColumn("persona", F.regexp_extract(F.input_file_name(), r"persona_(\d+)", 1).cast("long"))
    if personas is not None:
        df = df.where(F.col("persona").isin(personas))
    if most is not None:
        df = df.join(df.select("persona").distinct().orderBy("persona").limit(most), "persona", "left_semi")
    out = df.select("persona", F.posexplode("sessions").alias("original_index", "s")).select("persona", "original_index", "s.*")
    out = out.withColumn("is_noise", F.col("noise_id").isNotNull() | F.col("noise_family_id").isNotNull())
    return out if head is None else out.where(F.col("original_index") < head)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report is small by nature: one row per type, context or method."""
    out = df.coalesce(1).write.mode("overwrite")
    out.json(path) if kind == "json" else out.option("header", True).csv(path)


def json_round_trip(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/report-{uuid.uuid4().hex}"
    write_report(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


def csv_round_trip(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/report-{uuid.uuid4().hex}"
    write_report(df, path, "csv")
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table, read in ``parts`` ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()
