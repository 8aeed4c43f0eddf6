"""Experiments: the grid of specifications and data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(specs: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row for each specification (tag, datasets as an array) and each known data set it names."""
    return specs.select("tag", F.explode("datasets").alias("dataset")).join(F.broadcast(datasets.select("dataset").distinct()), "dataset", "left_semi")
