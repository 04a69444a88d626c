"""Registered queries by subject."""

from __future__ import annotations


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry():
    """(queries, SQL, decorator): the decorator names a query by its function and takes its SQL."""
    queries, sql = {}, {}

    def query(equivalent=None):
        def add(f):
            queries[f.__name__] = f
            if equivalent:
                sql[f.__name__] = equivalent
            return f

        return add

    return queries, sql, query
