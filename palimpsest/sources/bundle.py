"""Export of tables as JSON lines with a manifest, and their checked import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(df: DataFrame, name: str) -> DataFrame:
    """One row: the table's name, rows, and an order-free digest of its rows (two sums of 32-bit parts)."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), part(1).alias("sum_a"), part(9).alias("sum_b"))


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as compressed JSON lines and the manifest beside them; returns the manifest."""
    manifest = None
    for name, df in tables.items():
        df.write.option("compression", "gzip").option("ignoreNullFields", "false").json(f"{path}/{name}")
        one = digests(df, name).withColumn("schema", F.lit(df.schema.json()))
        manifest = one if manifest is None else manifest.unionByName(one)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export; a table whose rows don't match the manifest is an error."""
    from pyspark.sql.types import StructType
    import json

    out = {}
    for entry in spark.read.schema("name string, rows long, sum_a string, sum_b string, schema string").json(f"{path}/manifest").collect():
        df = spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).json(f"{path}/{entry['name']}")
        got = digests(df, entry["name"]).first()
        if (got["rows"], got["sum_a"], got["sum_b"]) != (entry["rows"], entry["sum_a"], entry["sum_b"]):
            raise ValueError(f"{entry['name']} doesn't match its manifest: {got['rows']} rows of {entry['rows']}")
        out[entry["name"]] = df
    return out


def unresolved(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Topology check before an import is taken: rows whose parent is missing."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
