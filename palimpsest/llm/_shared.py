"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see. Where it is unset, a temporary one for a local
    session; on a cluster no machine-local folder will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="palimpsest-")
    return _own[app]


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: later stages survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that clashing extra columns never reach an operator."""
    return df.select(*[F.col(c) for c in columns])
