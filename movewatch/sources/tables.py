"""Stored tables: scans with a fixed schema, so no file is opened to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movewatch import schemas

MAX_FINDINGS = 200


def companies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COMPANY).parquet(path).select("company_id", "name", "sector")


def bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BAR).parquet(path)


def news(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.NEWS).parquet(path)


def discussion(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DISCUSSION).parquet(path)


def named_companies(spark: SparkSession, rows: tuple = schemas.SEED_COMPANIES) -> DataFrame:
    """A fixed company list with its order, for seeding and for the watchlist union."""
    listed = [(*row, place) for place, row in enumerate(rows)]
    return spark.createDataFrame(listed, "company_id string, name string, sector string, ordinal int")


def list_findings(findings: DataFrame, ticker: str | None = None, limit: int = 50) -> DataFrame:
    """Newest findings, of one ticker if given; the limit is at least 1 and at most 200."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if ticker is not None:
        findings = findings.filter(F.col("company_id") == ticker.upper())
    return findings.orderBy(F.desc("created_at"), "id").limit(min(limit, MAX_FINDINGS))
