"""The small tables: accounts, connections, sessions, keys and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.operators.tenants import decode_policies
from mailsieve.schema import ACCOUNT, API_KEY, CONNECTION, SESSION

TABLES = {"accounts": ACCOUNT, "email_connections": CONNECTION, "sessions": SESSION, "api_keys": API_KEY}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TABLES[name]).format(fmt).load(path)


def read_policies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored policies. Read with the files' own schema: older snapshots lack
    some settings, which then take their defaults."""
    return decode_policies(spark.read.format(fmt).load(path))


def by_id(df: DataFrame, id_: str) -> DataFrame:
    return df.filter(F.col("id") == id_)


def by_email(df: DataFrame, email: str) -> DataFrame:
    return df.filter(F.col("email") == email)
