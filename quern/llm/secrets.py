"""Secret scans with corpus-wide ownership frequency.

Every text is searched by patterns.  Three kinds are reported wherever they stand
(assignments, access keys, hex runs).  Wider kinds (prefixed tokens, signed web
tokens, bearer headers, credentials in addresses, private-key blocks, mixed strings
of high entropy) match harmless strings too, so for these the corpus decides: the
hash of each candidate's value is aggregated over the whole corpus into the numbers
of distinct owners and distinct repositories that hold it.  A value that more than
``max_owners`` owners hold is a copied example; a value that few hold, that looks
random and carries no placeholder word, is live-looking, and its spans are added.
The base spans get the same verdicts as counts.  Only hashes leave a document.

Scale: one Arrow pass finds candidates; hashes are aggregated per (hash, owner) with
partial sums and then per hash, so a value in a third of all documents is one row a
task.  Verdicts go back by a join on the hash, whose sides are plain shuffles that
adaptive execution splits.

Defined cases: a null text is empty; a null owner or repository is one value of its
own; documents that repeat an id are scanned one by one; spans are code points, end
exclusive.  Extra columns are not read.  Which columns name the repository and the owner
are parameters; by default a document is a repository of its own and its source the owner.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import materialize, spread

# The base patterns, in the order of kinds, and the least length of each.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}

# Wider kinds, each with a string that every match holds (for speed).
WIDER = {
    "prefixed": (r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", ("gh", "xox", "sk_live_", "AIza")),
    "signed": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
    "bearer": (r"\b[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})", ("earer ",)),
    "address": (r"://[^\s/:@]+:([^\s/:@]{6,})@", ("://",)),  # and the scheme before it
    "private": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", ("PRIVATE KEY",)),
    "mixed": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])", tuple("0123456789")),
}
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_SCHEME_START = re.compile(r"\b[a-z]")
KINDS = (*BASE, *WIDER)
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "xxxx", "your", "test", "1234567890")


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entropy(value: str) -> float:
    """Bits a character by the value's own frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def live_looking(value: str) -> bool:
    """Random to look at, with no placeholder word and no run of one character."""
    low = value.lower()
    return entropy(value) >= 3.0 and not any(p in low for p in PLACEHOLDERS) and not re.search(r"(.)\1{5}", value)


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all candidates of one text, base kinds first."""
    text = text or ""
    found = []
    low = text.lower() if len(text) else ""
    if any(k in low for k in ("passw", "secret", "token", "api")):
        for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII):
            if len(m[2]) >= LEAST["assign"]:
                found.append(("assign", m.start(), m.end(), m[2]))
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in re.finditer(ACCESS, text) if len(m[0]) >= LEAST["access"]]
    # A run of the class is the same match whether or not its length is asked for.
    found += [("hex", m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9a-f]{16,}", text)]
    for kind, (pattern, marks) in WIDER.items():
        if any(mark in text for mark in marks):
            end = 0
            for m in re.finditer(pattern, text):
                value, start = m[m.lastindex or 0], m.start()
                if kind == "address":
                    start = _scheme(text, start, end)
                    if start is None:
                        continue
                    end = m.end()
                if kind != "mixed" or (re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value) and entropy(value) >= 3.5):
                    found.append((kind, start, m.end(), value))
    return found


def _scheme(text: str, at: int, least: int) -> int | None:
    """Where the scheme that ends at ``at`` begins, not before ``least``; None if there is none."""
    start = at
    while start > least and text[start - 1] in _SCHEME:
        start -= 1
    m = _SCHEME_START.search(text, start, at)
    return m.start() if m else None


_FIELDS = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.int64()), ("live", pa.bool_())])


def candidates(docs: DataFrame, *, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """doc_id, owner, repo, found (array of kind number, start, stop, hash, live)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": KINDS.index(k), "start": a, "stop": b, "hash": _hash(v), "live": live_looking(v)} for k, a, b, v in scan(t.as_py())] for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(_FIELDS))], ["doc_id", "owner", "repo", "found"])

    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, owner_col, repo_col)]
    schema = "doc_id {}, owner {}, repo {}, found array<struct<kind:int,start:long,stop:long,hash:long,live:boolean>>".format(*kinds)
    rows = docs.select(*[F.col(c).alias(n) for c, n in ((id_col, "doc_id"), (owner_col, "owner"), (repo_col, "repo"), (text_col, "text"))])
    return spread(rows).mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos of every candidate value."""
    each = found.select("owner", "repo", F.explode(F.array_distinct(F.transform("found", lambda x: x["hash"]))).alias("hash"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def find_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 2, max_repos: int = 50,
) -> DataFrame:
    """One row a document: doc_id, the base kinds' counts, base_spans, spans, n_live, n_copied, max_owners.

    ``base_spans`` and ``spans`` are ``kind:start:end``, by start, then kind, comma-joined.
    """
    found = materialize(candidates(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col).withColumn("row", F.monotonically_increasing_id()), "found")
    owners = materialize(ownership(found.filter(F.size("found") > 0)), "owners")
    spans = found.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    names = F.array(*[F.lit(k) for k in KINDS])
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)
    base = F.col("kind") < len(BASE)
    judged = (
        spans.join(owners, "hash")
        .withColumn("copied", copied).withColumn("is_live", F.col("live") & ~copied)
        .filter(base | F.col("is_live"))
        .withColumn("label", F.concat_ws(":", F.get(names, F.col("kind")), F.col("start"), F.col("stop")))
    )
    entry = F.struct("start", "kind", "stop", "label")
    joined = lambda x: F.array_join(F.transform(F.sort_array(x), lambda e: e["label"]), ",")
    by_row = judged.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        joined(F.collect_list(F.when(base, entry))).alias("base_spans"), joined(F.collect_set(entry)).alias("spans"),
        F.count(F.when(F.col("is_live"), 1)).alias("n_live"), F.count(F.when(F.col("copied"), 1)).alias("n_copied"), F.max("n_owners").alias("most_owners"),
    )
    zero = {c: 0 for c in (*[f"n_{k}" for k in BASE], "n_live", "n_copied", "most_owners")} | {"base_spans": "", "spans": ""}
    # Most documents hold nothing: they pass by, and only the others are shuffled.
    none = found.filter(F.size("found") == 0).select("doc_id", *[F.lit(v).cast("long" if v == 0 else "string").alias(k) for k, v in zero.items()])
    some = found.filter(F.size("found") > 0).select("doc_id", "row").join(by_row, "row", "left").drop("row").na.fill(zero, subset=list(zero))
    return some.unionByName(none)
