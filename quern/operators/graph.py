"""The typed knowledge graph: build, link, neighbours, bridges, entity contexts.

Nodes are rows of (node_id, label, node_type, sty, definition, source, ord), edges of
(src, dst, rel, source, ord); ``ord`` is any orderable value that says which row came
first.  Everything is joins and windows over these tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.postings import from_bytes, to_bytes
from quern.operators.retrieval import SMALL, small
from quern.storage import dealt, materialize

# Relations that carry knowledge, by their use, and relations to skip.
USEFUL_RELATIONS = (
    "isa", "inverse_isa", "may_treat", "may_prevent", "may_be_treated_by", "mechanism_of_action", "has_mechanism_of_action", "has_physiologic_effect",
    "has_active_ingredient", "has_ingredient", "causative_agent", "finding_site", "has_target", "associated_with", "causes", "has_part", "part_of",
    "disease_may_have_finding", "disease_may_have_associated_disease", "classified_as", "has_manifestation", "mapped_to", "due_to", "occurs_in",
    "RO", "RB", "RN", "PAR", "CHD", "has_tradename", "tradename_of", "precise_active_ingredient_of", "ingredient_of", "form_of", "has_form",
    "procedure_context_of", "associated_procedure_of", "component_of", "measured_by", "has_side_effect", "side_effect_of", "adverse_effect_of",
    "has_adverse_effect", "contraindicated_with", "may_cause", "has_contraindication", "produces",
)
SKIPPED_RELATIONS = ("has_class", "has_answer", "has_expanded_form", "expanded_form_of", "property_of", "time_aspect_of", "system_of", "scale_type_of")
HIGH_OUT = (
    "may_treat", "may_prevent", "may_be_treated_by", "mechanism_of_action", "has_mechanism_of_action", "has_physiologic_effect", "has_active_ingredient",
    "causative_agent", "finding_site", "has_target", "associated_with", "causes", "classified_as", "disease_may_have_finding", "has_side_effect",
    "side_effect_of", "adverse_effect_of", "has_adverse_effect", "contraindicated_with", "may_cause", "has_contraindication", "produces",
)
MEDIUM = ("isa", "inverse_isa", "RO", "RB", "RN", "PAR", "CHD")
HIGH_IN = (
    "may_treat", "may_prevent", "may_be_treated_by", "mechanism_of_action", "has_mechanism_of_action", "has_physiologic_effect", "has_active_ingredient",
    "causative_agent", "causes", "has_target", "has_side_effect", "side_effect_of", "adverse_effect_of", "has_adverse_effect", "may_cause", "produces",
)
# Labels of administrative nodes.
JUNK_LABELS = (
    "^Dose form", "^Frequency prescribed", "^Refills prescribed", "^Amount dispensed", "^Days' supply", "^Date ", "^Medication volume",
    "^Medication duration", "^Quantity prescribed", "^Reason for missed", ":Type:Pt:", ":Num:Pt:", ":NRat:Pt:", ":Date:Pt:", ":Vol:Pt:",
    ":Find:Pt:", ":Prid:Pt:", ":Time:Pt:",
)
# Single words that are no entity, and option words that do not count.
STOPWORDS = (
    "the", "and", "with", "this", "that", "for", "which", "patient", "history", "effects", "following", "primary", "primarily", "through", "these",
    "those", "have", "has", "had", "been", "most", "likely", "would", "what", "how", "does", "used", "man", "woman", "year", "old", "new", "due",
    "commonly", "known", "type", "including", "also", "one", "two", "her", "his", "she", "day", "days", "ago", "weeks",
)
OPTION_SKIP = ("selective", "inhibition", "blockade", "activation", "receptor", "yes", "no", "true", "false")


def is_junk(label: Column) -> Column:
    return F.rlike(label, F.lit("|".join(JUNK_LABELS)))


def option_words(text: Column) -> Column:
    """The distinct words of an option that count."""
    return F.array_except(F.filter(F.split(F.lower(text), " "), lambda w: w != ""), F.array(*[F.lit(w) for w in OPTION_SKIP]))


# --- Build ---------------------------------------------------------------------------------------


def first_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def last_wins(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair: its place is the first one's, its relation and source the last one's."""
    last = F.max_by(F.struct("rel", "source"), "ord")
    return edges.groupBy("src", "dst").agg(last.alias("last"), F.min("ord").alias("ord")).select("src", "dst", "last.rel", "last.source", "ord")


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes, those of a source in one place."""
    ids = nodes.select("node_id").distinct()
    few = ids.count() <= SMALL
    side = lambda end: ids.select(F.col("node_id").alias(end)).hint("broadcast" if few else "merge")
    # The join on the source comes last: by its shuffle edges lie by source, and what follows by pair needs no other.
    kept = edges.join(side("dst"), "dst", "left_semi").join(side("src"), "src", "left_semi")
    return kept.repartition("src") if few else kept


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph: first row of a node wins, last relation of a pair wins, loose ends go."""
    kept = materialize(first_wins(nodes, ["node_id"], F.asc("ord")), "nodes")
    return kept, last_wins(known_ends(edges, kept))


def crosswalk(rows: DataFrame, mapping: DataFrame, id_col: str, prefix: str = "SCT:") -> DataFrame:
    """``rows`` with node_id: the mapped id, else the prefixed own id; of several mappings the greatest ``ord`` wins."""
    last = mapping.groupBy("own_id").agg(F.max_by("mapped_id", "ord").alias("mapped_id"))
    return rows.join(last, rows[id_col] == last["own_id"], "left").withColumn("node_id", F.coalesce("mapped_id", F.concat(F.lit(prefix), F.col(id_col).cast("string")))).drop("own_id", "mapped_id")


def concept_terms(descriptions: DataFrame) -> DataFrame:
    """concept, fsn, pt of ``descriptions(concept, kind, term, ord)``: the last full name, the first preferred term that is not empty."""
    return descriptions.groupBy("concept").agg(
        F.max_by(F.when(F.col("kind") == "fsn", F.col("term")), F.when(F.col("kind") == "fsn", F.col("ord"))).alias("fsn"),
        F.min_by(F.when((F.col("kind") == "pt") & (F.col("term") != ""), F.col("term")), F.when((F.col("kind") == "pt") & (F.col("term") != ""), F.col("ord"))).alias("pt"),
    )


# --- Neighbours ----------------------------------------------------------------------------------


def neighbours(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, *, incoming: bool = False) -> DataFrame:
    """seed, rel, node_id, label, definition, ord of the nodes one edge away."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    ends = nodes.select(F.col("node_id").alias("_far"), "label", "definition")
    return (
        edges.join(seeds.select(F.col("node_id").alias("_near")).distinct(), F.col(near) == F.col("_near"))
        .join(ends, F.col(far) == F.col("_far")).select(F.col("_near").alias("seed"), "rel", F.col("_far").alias("node_id"), "label", "definition", "ord")
    )


def first_neighbours(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 5, *, incoming: bool = False, cut: int = 10) -> DataFrame:
    """Of :func:`neighbours` without junk labels, for each seed and relation, at least all those by ``ord`` up to the ``most``-th distinct label.

    Edges are cut to the first ``cut`` of a seed and relation (and their equals) before labels are joined; where these show too few labels all
    edges of the seed and relation are taken.
    """
    near, far = ("dst", "src") if incoming else ("src", "dst")
    own = edges.join(small(seeds.select(F.col("node_id").alias("seed")).distinct()), F.col(near) == F.col("seed")).select("seed", "rel", F.col(far).alias("node_id"), "ord")
    ends = nodes.select("node_id", "label", "definition")
    first = own.withColumn("_n", F.rank().over(Window.partitionBy("seed", "rel").orderBy("ord"))).filter(F.col("_n") <= cut).drop("_n")
    first = materialize(first.join(ends, "node_id", "left").select("seed", "rel", "node_id", "label", "definition", "ord"), "first")
    clean = ~is_junk(F.col("label"))
    shown = first.groupBy("seed", "rel").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set(F.when(clean, F.col("label")))).alias("labels"))
    short = materialize(shown.filter((F.col("n") >= cut) & (F.col("labels") < most)).select("seed", "rel"), "short")
    first = first.filter(clean)
    if short.isEmpty():
        return first
    short = small(short)
    rest = own.join(short, ["seed", "rel"], "left_semi").join(ends, "node_id").filter(clean).select(*first.columns)
    return first.join(short, ["seed", "rel"], "left_anti").select(*first.columns).unionByName(rest)


def bridges(seeds: DataFrame, edges: DataFrame, relations: tuple[str, ...] = HIGH_OUT) -> DataFrame:
    """seed, rel, via, bridge_rel, other: two edges of the given relations from one seed to another."""
    strong = edges.filter(F.col("rel").isin(*relations))
    ids = seeds.select("node_id").distinct()
    out = strong.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("src").alias("seed"), "rel", F.col("dst").alias("via"))
    back = strong.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(F.col("src").alias("via"), F.col("rel").alias("bridge_rel"), F.col("dst").alias("other"))
    return out.join(back, "via").filter(F.col("seed") != F.col("other")).select("seed", "rel", "via", "bridge_rel", "other")


def _numbered(ids: DataFrame) -> DataFrame:
    """``ids(node_id)`` with numbers from 0 without gaps."""
    rows = materialize(ids.select("node_id", F.monotonically_increasing_id().alias("at")), "numbers")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return rows.select("node_id", F.lit(0).alias("number"))
    starts = F.create_map(*[F.lit(x) for (p, _), start in zip(sizes, accumulate((n for _, n in sizes), initial=0)) for x in (p, start)])
    return rows.select("node_id", (F.element_at(starts, part) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("number"))


#: A group of seeds are at most 2 ** SHIFT whose numbers follow each other, and fewer where those of one would have over MEETINGS on average.
SHIFT, MEETINGS = 8, 1 << 24
#: Rows of a task that groups ends, and bytes of a task that counts pairs, as tasks are dealt out.
TASK_ROWS, TASK_BYTES = 2_000_000, 96 << 20


def _lasting(rows: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """src, dst of the pairs whose last relation in ``rows(src, dst, rel, source, ord)`` is one of those given; a pair can come several times.

    Rows are put in order only for pairs that have relations of both kinds.
    """
    wanted = F.coalesce(F.col("rel").isin(*relations), F.lit(False))
    strong = rows.filter(wanted).select("src", "dst")
    weak = materialize(rows.filter(~wanted).select("src", "dst").distinct(), "weak")
    mixed = materialize(strong.join(small(weak), ["src", "dst"], "left_semi").distinct(), "mixed")
    if mixed.isEmpty():
        return strong
    mixed = small(mixed)
    last = last_wins(rows.join(mixed, ["src", "dst"], "left_semi")).filter(wanted).select("src", "dst")
    return strong.join(mixed, ["src", "dst"], "left_anti").unionByName(last)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and how many each has."""
    return column.flatten().to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _by_group(lists: DataFrame, shift: int, most: int = 16 << 20) -> DataFrame:
    """group, seeds, others of ``lists(seeds, others)``: a row for each group among its seeds; others as bytes, sorted, each as the distance from the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            (a, na), (b, nb) = (_lists(batch.column(c)) for c in (0, 1))
            row = np.repeat(np.arange(len(batch)), na)
            a = a[np.lexsort((a, row))]
            b = b[np.lexsort((b, np.repeat(np.arange(len(batch)), nb)))]
            ends = np.concatenate([[0], np.cumsum(nb)])
            steps, firsts = np.diff(b, prepend=0), ends[:-1][nb > 0]
            steps[firsts] = b[firsts]
            data, sizes = to_bytes(steps)
            places = np.concatenate([[0], np.cumsum(sizes)])[ends].astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(places), pa.py_buffer(data)])
            first = np.flatnonzero(np.diff(row << 32 | a >> shift, prepend=-1))
            starts = np.append(first, len(a)).astype(np.int32)
            reach = np.cumsum(np.diff(places)[row[first]].astype(np.int64))
            at = 0
            while at < len(first):
                stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, side="right")))
                seeds = pa.ListArray.from_arrays(starts[at : stop + 1] - starts[at], pa.array(a[starts[at] : starts[stop]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array((a[first[at:stop]] >> shift).astype(np.int32)), seeds, packed.take(pa.array(row[first[at:stop]]))], ["group", "seeds", "others"])
                at = stop

    return lists.select("seeds", "others").mapInArrow(run, "group int, seeds array<int>, others binary")


def _met(held: list[pa.RecordBatch], pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """seed, other and how often they meet in the rows of a group, whole seeds of about ``pairs`` meetings at a time."""
    table = pa.Table.from_batches(held).combine_chunks()
    a, na = _lists(table.column("seeds").chunk(0))
    others = table.column("others").chunk(0)
    places = np.frombuffer(others.buffers()[1], np.int32)[others.offset : others.offset + len(others) + 1]
    steps, stops = from_bytes(np.frombuffer(others.buffers()[2], np.uint8)[places[0] : places[-1]])
    ends = np.searchsorted(stops, places - places[0], side="right")
    nb, total = np.diff(ends), np.concatenate([[0], np.cumsum(steps)])
    b = total[1:] - np.repeat(total[ends[:-1]], nb)
    order = np.argsort(a, kind="stable")
    a, row = a[order], np.repeat(np.arange(len(na)), na)[order]
    last = np.append(np.flatnonzero(np.diff(a)), len(a) - 1)  # of each seed
    reach = np.cumsum(nb[row])[last]
    at = 0
    while at < len(last):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + pairs, side="right")))
        part = slice(last[at - 1] + 1 if at else 0, last[stop - 1] + 1)
        n = nb[row[part]]
        other = b[np.repeat(ends[row[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        seeds = a[last[at:stop]]
        low, width = other.min(), int(np.ptp(other)) + 1
        keys = np.repeat(np.searchsorted(seeds, a[part]), n) * width + (other - low)
        if len(seeds) * width <= 4 * len(keys):
            counts = np.bincount(keys)
            keys = np.flatnonzero(counts)
            times = counts[keys]
        else:
            keys = np.sort(keys.astype(np.int32) if len(seeds) * width < 1 << 31 else keys)
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, times = keys[first].astype(np.int64), np.diff(first, append=len(keys))
        seed, other = seeds[keys // width], keys % width + low
        apart = seed != other
        yield seed[apart], other[apart], times[apart]
        at = stop


def _pair_counts(rows: DataFrame, pairs: int, most: int) -> DataFrame:
    """seed, other, bridges of ``rows(group, seeds, others)``, those of a group one after the other: how often the two meet in a row.

    The rows of a group are held, up to ``most`` bytes; of longer groups the counts are held and added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        size, group = 0, None

        def add() -> None:
            sums.extend((seed << 32 | other, times) for seed, other, times in _met(held, pairs))
            held.clear()
            keys, times = (np.concatenate(x) for x in zip(*sums, strict=True))
            keys, slot = np.unique(keys, return_inverse=True)
            sums[:] = [(keys, np.bincount(slot, times, len(keys)).astype(np.int64))]

        def done() -> Iterator[pa.RecordBatch]:
            if sums and held:
                add()
            found = ((keys >> 32, keys & 0xFFFFFFFF, times) for keys, times in sums) if sums else _met(held, pairs) if held else ()
            for seed, other, times in found:
                yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int32)), pa.array(other.astype(np.int32)), pa.array(times)], ["seed", "other", "bridges"])
            held.clear()
            sums.clear()

        for batch in batches:
            if not len(batch):
                continue
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for start, stop in zip(cuts, cuts[1:]):
                if groups[start] != group:
                    yield from done()
                    size, group = 0, groups[start]
                held.append(batch.slice(start, stop - start))
                size += held[-1].nbytes
                if size > most:
                    add()
                    size = 0
        yield from done()

    return rows.select("group", "seeds", "others").mapInArrow(run, "seed int, other int, bridges long")


def bridge_counts(
    seeds: DataFrame, edges: DataFrame, relations: tuple[str, ...] = HIGH_OUT, *, nodes: DataFrame | None = None, block: int = 4096, pairs: int = 1 << 18,
    most: int = 16 << 20,
) -> DataFrame:
    """seed, other, bridges: the number of rows that :func:`bridges` has for each two seeds, which are not made one by one.

    With ``nodes`` the edges are rows that are not built yet (see :func:`build`): of these only ends are moved, and seeds must be among the nodes.

    Seeds are numbered by id, as those with ids alike often share nodes.  Each node between has its seeds and its others as lists; the others are
    sent, packed, once to each group of seeds, and a task counts the pairs of one group after the other, up to ``pairs`` at a time.
    """
    spark = seeds.sparkSession
    deal = lambda df, parts, key: df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts), key)
    strong = edges.filter(F.col("rel").isin(*relations)).select("src", "dst") if nodes is None else _lasting(edges, relations)
    ids = _numbered(seeds.select("node_id").distinct().orderBy("node_id"))
    count = ids.count()
    known = small(ids)
    ends = lambda own, via, back: strong.join(known, F.col(own) == F.col("node_id")).select(F.col(via).alias("via"), "number", F.lit(back).alias("back"))
    ways = deal(ends("src", "dst", False).unionByName(ends("dst", "src", True)), 2 * strong.count() // TASK_ROWS, "via")
    lists = ways.groupBy("via").agg(F.collect_list(F.when(~F.col("back"), F.col("number"))).alias("seeds"), F.collect_list(F.when(F.col("back"), F.col("number"))).alias("others"))
    lists = lists.filter("size(seeds) > 0 and size(others) > 0")
    if nodes is not None:
        lists = lists.join(nodes.select(F.col("node_id").alias("via")), "via", "left_semi").select(F.array_distinct("seeds").alias("seeds"), F.array_distinct("others").alias("others"))
    lists = materialize(lists.select("seeds", F.explode(F.transform(F.sequence(F.lit(1), F.size("others"), F.lit(block)), lambda i: F.slice("others", i, block))).alias("others")), "lists")
    met, rows = (x or 0 for x in lists.agg(F.sum(F.size("seeds").cast("long") * F.size("others")), F.sum(F.size("seeds"))).first())
    size = 3 * met + 48 * rows
    shift = max(0, min(SHIFT, min(count // (4 * spark.sparkContext.defaultParallelism), MEETINGS * count // max(1, met)).bit_length() - 1))
    counted = _pair_counts(deal(_by_group(lists, shift), min(size // TASK_BYTES, count >> shift), "group").sortWithinPartitions("group"), pairs, most)
    name = lambda c: known.select(F.col("number").alias(c + "_number"), F.col("node_id").alias(c))
    return (
        counted.withColumnsRenamed({"seed": "seed_number", "other": "other_number"}).join(name("seed"), "seed_number").join(name("other"), "other_number")
        .select("seed", "other", "bridges")
    )


def paths(seeded: DataFrame, edges: DataFrame, hops: int = 2, *, relations: tuple[str, ...] = (), degree: int | None = None, both_ways: bool = False) -> DataFrame:
    """qid, node_id, hops, parent, rel of all nodes within ``hops`` edges of ``seeded(qid, node_id)``, by the least number of edges.

    The frontier is expanded level by level, and nodes that were reached before are left out by an anti-join.  Of several edges that reach a
    node at its level the one whose relation comes first in ``relations`` is its parent's (others after all of these), then the smaller parent and
    relation.  With ``degree`` only that many edges of a node, by relation and ``ord``, are followed.  Seeds have no parent.
    """
    place = F.coalesce(*[F.when(F.col("rel") == r, F.lit(i)) for i, r in enumerate(relations)], F.lit(len(relations)))
    links = edges.select("src", "dst", "rel", "ord")
    if both_ways:
        links = links.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "ord"))
    links = links.groupBy("src", "dst", "rel").agg(F.min("ord").alias("ord")).withColumn("place", place)
    if degree is not None:
        links = _ranked(links, ["src"], [F.asc("place"), F.asc("ord"), F.asc("dst")], degree).drop("rank")
    links = materialize(links.select("src", "dst", "rel", "place"), "links")
    none = F.lit(None).cast("string")
    level = materialize(seeded.select("qid", "node_id").distinct().select("qid", "node_id", F.lit(0).alias("hops"), none.alias("parent"), none.alias("rel")), "level")
    found = level
    for hop in range(1, hops + 1):
        reached = level.select("qid", F.col("node_id").alias("src")).join(links, "src").groupBy("qid", F.col("dst").alias("node_id")).agg(F.min(F.struct("place", "src", "rel")).alias("best"))
        fresh = reached.join(found.select("qid", "node_id"), ["qid", "node_id"], "left_anti")
        level = materialize(fresh.select("qid", "node_id", F.lit(hop).alias("hops"), F.col("best.src").alias("parent"), F.col("best.rel").alias("rel")), "level")
        found = found.unionByName(level)
    return found


# --- Linking -------------------------------------------------------------------------------------


def _ranked(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    # The number itself is compared, so that a task keeps ``most`` rows of a group before they are shuffled.
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most).withColumn("rank", F.col("rank") - 1)


def link_exact(queries: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """qid, rank, node_id: nodes whose label is a run of up to five words of ``queries(qid, text)``.

    Longer runs come first, then earlier ones, then earlier nodes.  As a node has one
    label and only ``most`` are wanted, no more nodes of a label are joined.
    """
    # Queries are dealt out once; what follows keeps their texts' rows where they are.
    words = dealt(queries.select("qid", "text"), "qid").select("qid", T.ascii_tokens(F.col("text")).alias("w"))
    each = F.array(*[F.struct(F.lit(n).alias("n"), T.ngrams(F.col("w"), n).alias("g")) for n in range(5, 0, -1)])
    grams = words.select("qid", F.explode(each).alias("e")).select("qid", "e.n", F.posexplode("e.g").alias("at", "gram"))
    single = (F.col("n") == 1) & ((F.length("gram") < 4) | F.col("gram").isin(*STOPWORDS))
    labels = _ranked(nodes.select(F.lower("label").alias("gram"), "node_id", "ord").distinct(), ["gram"], [F.asc("ord")], most).drop("rank")
    hits = grams.filter(~single).join(small(materialize(labels, "labels")), "gram")
    best = hits.groupBy("qid", "node_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "at", "ord")).alias("place"))
    return _ranked(best, ["qid"], [F.asc("place")], most).select("qid", "rank", "node_id")


def terms_in(labels: DataFrame, terms: DataFrame, chunk: int = 200_000) -> DataFrame:
    """label, term of every label of ``labels(label)`` that holds a term of ``terms(term)``, each pair once.

    An Aho-Corasick automaton of up to ``chunk`` distinct terms goes over each label once, so the work is labels and
    matches, not labels and terms; more terms are several automata.
    """
    spark = labels.sparkSession
    wanted = materialize(terms.select("term").filter("term <> ''").distinct(), "terms")
    parts = -(-wanted.count() // chunk)
    numbered = wanted.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(max(parts, 1))))

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for term in held.value:
                automaton.add_word(term, term)
            automaton.make_automaton()
            for batch in batches:
                pairs = [(x, t) for x in batch.column(0).to_pylist() if x for t in sorted({t for _, t in automaton.iter(x)})]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["label", "term"])

        return run

    once = labels.select("label").distinct()
    found = spark.createDataFrame([], "label string, term string")
    for part in range(parts):
        held = spark.sparkContext.broadcast([r.term for r in numbered.filter(F.col("part") == part).select("term").collect()])
        if held.value:
            found = found.unionByName(once.mapInArrow(search(held), "label string, term string"))
    return found


def link_fuzzy(terms: DataFrame, nodes: DataFrame, most: int = 5, chunk: int = 200_000) -> DataFrame:
    """qid, rank, node_id: nodes whose label holds the term of ``terms(qid, text)`` of three characters or more.

    Nodes with a definition come first, then UMLS nodes, then shorter labels.
    """
    wanted = materialize(terms.select("qid", F.lower(T.strip(F.col("text"))).alias("term")).filter(F.length("term") >= 3).distinct(), "wanted")
    score = F.when(F.trim(F.coalesce("definition", F.lit(""))) != "", 10).otherwise(0) + F.when(F.col("node_type") == "umls", 5).otherwise(0)
    each = nodes.select("node_id", F.lower("label").alias("label"), score.alias("rank_class"), "ord")
    each = materialize(_ranked(each, ["label", "rank_class"], [F.asc("ord")], most).drop("rank"), "labels")
    # What a term finds is the same for all queries, and beyond its best nodes none is any query's.
    hits = terms_in(each, wanted, chunk).join(each, "label").withColumn("score", F.col("rank_class") - F.length("label") * 0.01)
    found = hits.groupBy("term", "node_id").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))
    found = materialize(_ranked(found, ["term"], [F.desc("score"), F.asc("ord")], most).drop("rank"), "found")
    best = dealt(wanted, "qid").join(small(found), "term").groupBy("qid", "node_id").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))
    return _ranked(best, ["qid"], [F.desc("score"), F.asc("ord")], most).select("qid", "rank", "node_id")


def seeds(queries: DataFrame, entities: DataFrame, options: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, rank, node_id, in order of first appearance.

    From the query by exact links (10), from each of ``entities(qid, at, text)`` by exact
    (3) and fuzzy (3) links, from each of ``options(qid, at, text)`` with two words that
    count by fuzzy links (2).
    """
    def linked(rows: DataFrame, link, most: int, stage: int, kind: int) -> DataFrame:
        keyed = rows.select(F.struct("qid", "at").alias("qid"), "text")
        return link(keyed, nodes, most).select("qid.qid", F.struct(F.lit(stage).alias("stage"), F.col("qid.at").alias("at"), F.lit(kind).alias("kind"), "rank").alias("place"), "node_id")

    query = queries.select("qid", F.lit(0).alias("at"), "text")
    counted = options.filter(F.size(option_words(F.col("text"))) >= 2)
    union = linked(query, link_exact, 10, 0, 0)
    for rows, link, most, stage, kind in ((entities, link_exact, 3, 1, 0), (entities, link_fuzzy, 3, 1, 1), (counted, link_fuzzy, 2, 2, 0)):
        union = union.unionByName(linked(rows, link, most, stage, kind))
    first = union.groupBy("qid", "node_id").agg(F.min("place").alias("place"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place")) - 1).select("qid", "rank", "node_id")


# --- Entity contexts -----------------------------------------------------------------------------


def _relation_lines(hits: DataFrame, prefix: str) -> DataFrame:
    """node, section lines: for each relation its first five distinct labels, relations in order."""
    once = hits.groupBy("seed", "rel", "label").agg(F.min("ord").alias("ord"))
    hits = _ranked(once, ["seed", "rel"], [F.asc("ord"), F.asc("label")], 5)
    labels = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"])
    shown = F.initcap(F.translate("rel", "_", " "))
    lines = hits.groupBy("seed", "rel").agg(labels.alias("labels")).select("seed", "rel", F.concat(F.lit(prefix), shown, F.lit(": "), F.array_join("labels", ", ")).alias("line"))
    return lines.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("rel", "line"))), lambda x: x["line"]).alias("lines"))


def contexts(seeded: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, rank, node_id, title, content: a document for each of ``seeded(qid, rank, node_id)`` that has anything to say.

    A neighbour's definition is not repeated where the neighbour is an earlier seed with
    a document of its own; whether a seed has one never depends on the others, so this
    is a join and not a loop.
    """
    ids = seeded.select("node_id").distinct()
    quiet = edges.filter(~F.col("rel").isin(*SKIPPED_RELATIONS))
    known = quiet.filter(F.col("rel").isin(*HIGH_OUT, *MEDIUM))
    first_five = lambda hits: _ranked(hits, ["seed", "rel"], [F.asc("ord")], 5).drop("rank")
    # No more of a relation is shown than its first five labels and first three neighbours.
    out = first_neighbours(ids, nodes, known)
    strong, medium = out.filter(F.col("rel").isin(*HIGH_OUT)), first_five(out.filter(F.col("rel").isin(*MEDIUM)))
    back = first_five(first_neighbours(ids, nodes, quiet.filter(F.col("rel").isin(*HIGH_IN, *MEDIUM)), incoming=True))
    out_lines, in_lines = _relation_lines(strong.unionByName(medium), "- "), _relation_lines(back, "- [Inverse] ")

    # Details: of the first three neighbours of each strong relation, their definitions and the bridges to other seeds.
    # Relations come in the order in which the seed's edges first show them.
    rel_at = F.min("ord").over(Window.partitionBy("seed", "rel"))
    nearest = _ranked(strong, ["seed", "rel"], [F.asc("ord")], 3).withColumn("rel_at", rel_at)
    per_query = seeded.select("qid", F.col("node_id").alias("seed"), F.col("rank").alias("seed_rank"))
    details = per_query.join(nearest.withColumnRenamed("rank", "nth").withColumnRenamed("node_id", "via").withColumnRenamed("label", "via_label"), "seed")
    own = nodes.select(F.col("node_id").alias("seed"), F.col("label").alias("seed_label"), "sty", F.col("definition").alias("seed_definition"))
    head = F.array_compact(F.array(
        F.when(F.coalesce("sty", F.lit("")) != "", F.concat(F.lit("Type: "), "sty")),
        F.when(F.coalesce("seed_definition", F.lit("")) != "", F.concat(F.lit("Definition: "), F.substring("seed_definition", 1, 400))),
    ))
    empty = F.array().cast("array<string>")
    basis = (
        ids.withColumnRenamed("node_id", "seed").join(own, "seed").filter(~is_junk(F.col("seed_label")))
        .join(out_lines.withColumnRenamed("lines", "outs"), "seed", "left").join(in_lines.withColumnRenamed("lines", "ins"), "seed", "left")
        .select("seed", "seed_label", F.concat(head, F.coalesce("outs", empty), F.coalesce("ins", empty)).alias("lines"))
    )
    basis = materialize(basis, "basis")
    # A strong neighbour gives a line by itself, so details never decide whether there is a document.
    speaking = seeded.join(basis.filter(F.size("lines") > 0).select(F.col("seed").alias("node_id")), "node_id", "left_semi").select(F.col("qid").alias("_q"), F.col("node_id").alias("_n"), F.col("rank").alias("_r"))
    fresh = details.join(speaking, (F.col("qid") == F.col("_q")) & (F.col("via") == F.col("_n")) & (F.col("_r") < F.col("seed_rank")), "left_anti")
    defined = fresh.filter(F.length(F.trim("definition")) > 30).select("qid", "seed", F.struct("rel_at", "nth", F.lit(0).cast("long").alias("kind"), F.lit(-1).alias("other")).alias("place"),
        F.concat(F.lit("  ["), "via_label", F.lit("]: "), F.substring(F.trim("definition"), 1, 200)).alias("line"))
    names = nodes.select(F.col("node_id").alias("other"), F.col("label").alias("other_label"))
    others = small(materialize(seeded.select("qid", F.col("node_id").alias("other"), F.col("rank").alias("other_rank")).join(names, "other"), "others"))
    links = edges.filter(F.col("rel").isin(*HIGH_OUT)).select(F.col("src").alias("via"), F.col("dst").alias("other"), F.col("rel").alias("bridge_rel"))
    links = links.join(small(ids.withColumnRenamed("node_id", "other")), "other", "left_semi")
    bridged = (
        fresh.join(links, "via").filter(F.col("other") != F.col("seed")).join(others, ["qid", "other"])
        .select("qid", "seed", F.struct("rel_at", "nth", F.lit(1).cast("long").alias("kind"), F.col("other_rank").alias("other")).alias("place"),
            F.concat(F.lit("  ["), "via_label", F.lit("] --"), "bridge_rel", F.lit("--> ["), "other_label", F.lit("]")).alias("line"))
    )
    eight = _ranked(defined.unionByName(bridged), ["qid", "seed"], [F.asc("place"), F.asc("line")], 8).groupBy("qid", "seed").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("details"))
    return (
        seeded.join(basis.filter(F.size("lines") > 0).withColumnRenamed("seed", "node_id"), "node_id")
        .join(eight.withColumnRenamed("seed", "node_id"), ["qid", "node_id"], "left")
        .withColumn("body", F.concat("lines", F.when(F.col("details").isNotNull(), F.concat(F.array(F.lit("Related details:")), "details")).otherwise(empty)))
        .select("qid", "rank", "node_id", F.concat(F.lit("KG: "), "seed_label").alias("title"), F.concat(F.lit("Entity: "), "seed_label", F.lit("\n"), F.array_join("body", "\n")).alias("content"))
    )


def retrieve(queries: DataFrame, seeded: DataFrame, nodes: DataFrame, edges: DataFrame, propositions: DataFrame | None = None, k: int = 20, min_score: float = 0.15) -> DataFrame:
    """qid, rank, title, content, score: the seeds' documents in order that pass the relevance gate, propositions first, all of score 1."""
    from quern.operators.retrieval import relevance_gate

    # The gate reads the documents twice.
    docs = materialize(contexts(seeded, nodes, edges).select("qid", "rank", F.col("rank").cast("long").alias("doc_id"), "title", "content"), "documents")
    if propositions is not None:
        text = F.concat(F.lit("Key medical claims to verify:\n"), F.array_join(F.transform("propositions", lambda p: F.concat(F.lit("- "), p)), "\n"))
        docs = docs.unionByName(propositions.filter(F.size("propositions") > 0).select("qid", F.lit(-1).alias("rank"), F.lit(-2).cast("long").alias("doc_id"), F.lit("Atomic Propositions").alias("title"), text.alias("content")))
    gated = relevance_gate(docs, queries, min_score=min_score)
    return gated.filter(F.col("rank") < k).select("qid", "rank", "title", "content", F.lit(1.0).alias("score"))
