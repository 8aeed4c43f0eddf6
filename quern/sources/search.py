"""Batch access to search services: request keys, batches of ids, and a cache of answers.

No network is assumed: a service is a function of a DataFrame of requests, and what has
been answered before is read from the cache table by an anti-join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_key(kind: str, db: Column | str, query: Column, n: int) -> Column:
    """md5 of ``kind:db:query:n``."""
    return F.md5(F.concat_ws(":", F.lit(kind), F.lit(db) if isinstance(db, str) else db, query, F.lit(str(n))))


def batched_ids(rows: DataFrame, id_col: str, group: str, size: int = 50) -> DataFrame:
    """group, batch, ids: each group's ids in order, ``size`` to a batch."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(id_col))
    return rows.select(group, id_col, F.floor((at - 1) / size).cast("int").alias("batch")).groupBy(group, "batch").agg(F.sort_array(F.collect_list(id_col)).alias("ids"))


def through_cache(requests: DataFrame, cache: DataFrame, service: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> DataFrame:
    """Answers of all requests: cached ones by a semi-join, the others from ``service``."""
    known = cache.join(requests.select(key).distinct(), key, "left_semi")
    asked = requests.join(cache.select(key).distinct(), key, "left_anti")
    return known.unionByName(service(asked), allowMissingColumns=True)
