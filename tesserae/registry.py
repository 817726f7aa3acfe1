"""All registered queries of the image engine, with the SQL that must give the same rows."""

from tesserae.plans import kernels, relational, roads, streams


def queries() -> dict:
    return {n: relational.spark_query(n) for n in relational.PLANS} | kernels.QUERIES | roads.ROADS | streams.QUERIES


def oracles() -> dict:
    return {n: relational.duck_sql(n) for n in relational.PLANS} | kernels.SQL | streams.SQL
