"""Pipe- and tab-delimited ontology files, and the row filters of their ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the ingest keeps.
SEMANTIC_TYPES = (
    "T047", "T048", "T184", "T033", "T046", "T191", "T121", "T109", "T195", "T126", "T116", "T023", "T022", "T029", "T060", "T061", "T059", "T201",
    "T034", "T200", "T203", "T074",
)
RELATION_TYPES = ("RB", "RN", "SY", "CHD", "PAR", "RO", "RL")
RELATION_ATTRIBUTES = (
    "has_ingredient", "ingredient_of", "may_treat", "treats", "may_prevent", "contraindicated_with", "cause_of", "associated_with", "isa", "inverse_isa",
    "has_finding_site", "part_of", "has_part", "classified_as",
)
DRUG_RELATIONS = ("has_ingredient", "ingredient_of", "has_tradename", "tradename_of", "contains", "contained_in", "isa", "inverse_isa")
DRUG_ATTRIBUTES = ("RXAUI_STRENGTH", "RXN_STRENGTH", "RXN_HUMAN_DRUG", "NDC", "UMLSCUI")
TERM_TYPES = ("IN", "BN", "PIN", "MIN", "SCDF", "SCD", "BPCK", "GPCK", "SBD", "SBDF")


def split_rows(lines: DataFrame, fields: dict[str, int], least: int, sep: str = r"\|", column: str = "value") -> DataFrame:
    """Lines with at least ``least`` fields, as named columns by position; shorter lines are skipped."""
    parts = F.split(F.trim(column), sep)
    return lines.select(parts.alias("_f")).filter(F.size("_f") >= least).select(*[F.get("_f", F.lit(i)).alias(n) for n, i in fields.items()])


def read_rrf(spark: SparkSession, path: str, fields: dict[str, int], least: int) -> DataFrame:
    """A headerless file of fields that end in ``|``."""
    return split_rows(spark.read.text(path), fields, least)


def read_snapshot(spark: SparkSession, folder: str, prefix: str, fields: dict[str, int], least: int) -> DataFrame:
    """Tab-separated snapshot files below ``folder`` whose names start with ``prefix``; header lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*.txt").text(folder)
    return split_rows(lines.filter(~F.startswith("value", F.lit("id\t"))), fields, least, "\t")


def keep_concept(lat: Column, sab: Column, tty: Column) -> Column:
    """English or of the drug vocabulary, and of a term type in use."""
    return ((lat == "ENG") | (sab == "RXNORM")) & tty.isin(*TERM_TYPES)


def keep_drug_relation(rela: Column) -> Column:
    low = F.lower(F.coalesce(rela, F.lit("")))
    return (low == "") | low.isin(*DRUG_RELATIONS)


def keep_relation(rel: Column, rela: Column) -> Column:
    return rel.isin(*RELATION_TYPES) | F.lower(rela).isin(*RELATION_ATTRIBUTES)


def preferred(ispref: Column, ts: Column) -> Column:
    return F.when((ispref == "Y") & (ts == "P"), 1).otherwise(0)
