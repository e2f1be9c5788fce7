"""Tables of a store: made and brought up to date from their schemas, emptied, dropped."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def _fields(spark: SparkSession, ddl: str) -> T.StructType:
    return spark.createDataFrame([], ddl).schema


def migrated(spark: SparkSession, tables: dict[str, str], partitions: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Makes tables (name: columns as DDL) that are missing and adds columns that old ones lack; told are the columns added, by table.

    Running it again changes nothing. A column whose type differs is an error, as files cannot be changed in place.
    """
    added = {}
    for name, ddl in tables.items():
        by = (partitions or {}).get(name)
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet" + (f" PARTITIONED BY ({by})" if by else ""))
            added[name] = _fields(spark, ddl).names
            continue
        old = {f.name.lower(): f.dataType for f in spark.table(name).schema}
        new = [f for f in _fields(spark, ddl) if f.name.lower() not in old]
        wrong = [f.name for f in _fields(spark, ddl) if old.get(f.name.lower(), f.dataType) != f.dataType]
        if wrong:
            raise ValueError(f"{name}: other types than the table has: {', '.join(wrong)}")
        if new:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        added[name] = [f.name for f in new]
    return added


def emptied(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"TRUNCATE TABLE {name}")


def dropped(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
