"""Readers of catalogues in tab-separated and JSON lines; quoted dumps are in dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines of at least as many fields as columns; blanks are null; access is allow or deny."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= len(columns)).select(*(F.nullif(F.trim(f[i]), F.lit("")).alias(c) for i, c in enumerate(columns)))
    return rows.withColumn("access", F.when(F.lower("access") == "allow", "allow").otherwise("deny")) if "access" in columns else rows


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Bibliographic records: those without an id are dropped; title and year by fallbacks; lists stay JSON; records that were not found have their ids only."""
    record = "struct<title:string,titleInfo:struct<text:string>,creator:string,machineReadableDate:string,subjects:array<string>,not_found:string>"
    rows = spark.read.schema(f"aacid string, metadata struct<oclc_number:string,type:string,record:{record}>").json(path).where("aacid is not null")
    r = F.col("metadata.record")
    lost = r["not_found"].isNotNull()
    told = {"title": F.coalesce(r["title"], r["titleInfo"]["text"]), "creator": r["creator"], "date_year": F.substring(r["machineReadableDate"], 1, 4).try_cast("int"), "subjects": F.to_json(r["subjects"])}
    kind = F.when(lost, "not_found").otherwise(F.col("metadata.type"))
    return rows.select("aacid", F.col("metadata.oclc_number").alias("oclc_number"), kind.alias("record_type"), *(F.when(~lost, c).alias(n) for n, c in told.items()))
