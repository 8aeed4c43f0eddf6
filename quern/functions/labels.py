"""Answer letters and label names, as the evaluations read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import strip

# What a letter means in each data set.
LETTER_NAMES = {
    "bioasq": {"A": "Yes", "B": "No"},
    "medchangeqa": {"A": "SUPPORTED", "B": "REFUTED", "C": "NEI"},
    "healthfc": {"A": "True", "B": "False", "C": "Mixture"},
    "scifact": {"A": "SUPPORT", "B": "CONTRADICT", "C": "NEI"},
    "medqa": {"A": "A", "B": "B", "C": "C", "D": "D"},
}
# The numbers of one data set, which two evaluations read in two ways.
NUMBER_SCHEMES = {"eval": {"0": "A", "1": "C", "2": "B"}, "additional": {"0": "A", "1": "B", "2": "C"}}
# Spellings of a label, by data set.
SPELLINGS = {
    "bioasq": {"yes": ("yes", "a", "1", "true"), "no": ("no", "b", "0", "false")},
    "healthfc": {"true": ("true", "a", "0"), "false": ("false", "b", "1"), "mixture": ("mixture", "c", "2")},
    "medchangeqa": {"supported": ("supported", "a", "true"), "refuted": ("refuted", "b", "false"), "nei": ("not enough information", "c", "nei")},
}
#: Data sets in the order in which a file name is searched for them.
DATASETS = ("bioasq", "medchangeqa", "healthfc", "scifact", "medqa")


def normalize_answer(x: Column) -> Column:
    """The first letter A to E that stands alone, else A for YES, B for NO, else the first character; empty for none."""
    up = F.upper(strip(F.coalesce(x.cast("string"), F.lit(""))))
    letter = F.regexp_extract(up, r"(?:^|[^A-Z0-9_])([ABCDE])(?:$|[^A-Z0-9_])", 1)
    return F.when(letter != "", letter).when(F.contains(up, F.lit("YES")), "A").when(F.contains(up, F.lit("NO")), "B").otherwise(F.substring(up, 1, 1))


def normalize_label(label: Column, dataset: Column, scheme: str = "eval") -> Column:
    """The data set's name for a letter or, in healthfc, a number; other labels in upper case."""
    up = F.upper(strip(F.coalesce(label.cast("string"), F.lit("NONE"))))
    number = F.coalesce(*[F.when(up == n, F.lit(a)) for n, a in NUMBER_SCHEMES[scheme].items()])
    key = F.coalesce(F.when(dataset == "healthfc", number), up)
    named = [F.when((dataset == d) & (key == k), F.lit(v)) for d, names in LETTER_NAMES.items() for k, v in names.items()]
    return F.coalesce(*named, key)


def parse_label(label: Column, dataset: Column) -> Column:
    """The canonical spelling of a label in its data set, else the label in lower case."""
    low = F.lower(strip(label.cast("string")))
    known = [F.when((dataset == d) & low.isin(*spellings), F.lit(name)) for d, names in SPELLINGS.items() for name, spellings in names.items()]
    return F.coalesce(*known, low)


def dataset_of(file_name: Column) -> Column:
    """The first data set whose name the file name holds, else ``unknown``."""
    low = F.lower(file_name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(d)), F.lit(d)) for d in DATASETS], F.lit("unknown"))
