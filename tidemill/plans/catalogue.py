"""The registered queries: each runs operators of the package on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import graphs, metadata, relational, scripts, warehouse
from .registry import Query

_PARTS = (relational.query, warehouse.query, metadata.query, scripts.query, graphs.query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.flagship_customer_status(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: f for part in _PARTS for k, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.sql.items()}
