"""References to sections: resolution, pools and policy maps."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.text import context_references
from ragspark.operators.ranking import number_rows
from ragspark.session import materialise, spread


BLOCK = 1024


def _targets(refs: DataFrame) -> DataFrame:
    """Distinct references that name a module, chapter or section: ref, kind, target."""
    text = F.trim("ref")
    module = F.lower(F.regexp_extract(text, r"^(\S+)", 1))
    nums = F.regexp_extract(text, r"^\S+\s+(.*)$", 1)
    parts = F.split(nums, r"\.")
    target = F.concat(module, F.lower(F.element_at(parts, 1)), F.lit("s"), F.get(parts, F.lit(1)))
    kind = (
        F.when(nums == "", "module").when(nums.rlike(r"^\d+[A-Za-z]?$"), "chapter")
        .when(F.size(parts) >= 2, "section")
    )
    return refs.select("ref").distinct().select(
        "ref", kind.alias("kind"),
        F.when(kind == "module", module).when(kind == "chapter", F.concat(module, F.lower(nums))).otherwise(target).alias("target"),
    ).where(F.col("kind").isNotNull())


def reference_intervals(refs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections behind each distinct ``ref`` as intervals of a sorted dictionary, and the dictionary.

    The dictionary ``(section_id, place)`` holds every section twice: in byte order of the ids and, apart from
    that, in order of chapter and id. All ids with a prefix are neighbours there, and so are all of a chapter, so a
    bare module, however many sections it has, is one interval ``(ref, first, last)``. The ends of
    the intervals are sorted into the dictionary along with it, hence nothing is compared pairwise, and their places are gaps.
    ``x.y`` means its exact id and only without one the prefix.
    """
    wanted = materialise(_targets(refs))
    ids = index.where(F.col("section_id").isNotNull())
    # Keys are bytes: 0xFF is in no UTF-8 text, so it ends a prefix; 0x00 comes right after the target itself.
    key = lambda space, *parts: F.concat(F.lit(space.encode()), *[F.lit(x) if isinstance(x, bytes) else F.col(x).cast("binary") for x in parts])
    none = F.lit(None).cast("string")
    entries = ids.select(key("i", "section_id").alias("key"), "section_id").unionByName(
        ids.where(F.col("chapter").isNotNull()).select(key("c", "chapter", b"\x00", "section_id").alias("key"), "section_id")
    )
    chapter = F.col("kind") == "chapter"
    ends = {
        "low": F.when(chapter, key("c", "target", b"\x00")).otherwise(key("i", "target")),
        "exact": F.when(~chapter, key("i", "target", b"\x00")),
        "high": F.when(chapter, key("c", "target", b"\x01")).otherwise(key("i", "target", b"\xff")),
    }
    probes = wanted.select("ref", "kind", F.explode(F.array(*[F.struct(F.lit(k).alias("end"), v.alias("key")) for k, v in ends.items()])).alias("p"))
    probes = probes.select("ref", "kind", "p.*").where(F.col("key").isNotNull())
    both = entries.select("key", "section_id").unionByName(probes.select("key").distinct().select("key", none.alias("section_id")))
    placed = materialise(number_rows(both, [], [F.col("key"), F.col("section_id").asc_nulls_first()], "place"))
    at = probes.join(placed.where("section_id IS NULL").select("key", "place"), "key").groupBy("ref", "kind").agg(
        *[F.max(F.when(F.col("end") == k, F.col("place"))).alias(k) for k in ends]
    )
    # Ends are distinct, so only sections of that very id can lie between a target and the key right after it.
    found = (F.col("kind") == "section") & (F.col("exact") - F.col("low") > 1)
    spans = at.select("ref", (F.col("low") + 1).alias("first"), (F.when(found, F.col("exact")).otherwise(F.col("high")) - 1).alias("last"))
    return materialise(spans.where("first <= last")), placed.where("section_id IS NOT NULL").select("section_id", "place")


def _sections_in(intervals: DataFrame, words: DataFrame) -> DataFrame:
    """The rows of ``intervals(first, last, …)`` for every section inside, with ``section_id``.

    Intervals are cut at blocks of places, so no key of the join has more than one block of sections.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    cut = intervals.withColumn("_block", F.explode(F.sequence(block("first"), block("last"))))
    blocks = words.select("section_id", "place", block("place").alias("_block"))
    found = cut.join(blocks, "_block").where("place BETWEEN first AND last")
    return found.drop("_block", "place", "first", "last")


def resolve_references(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Sections behind each distinct ``ref``: ``ref, section_id``.

    A bare module matches by id prefix, a chapter by equality, ``x.y`` by exact
    id and only without one by prefix. ``index(section_id, chapter)``.
    """
    spans, words = reference_intervals(refs, index)
    return _sections_in(spans, words).select("ref", "section_id")


def _policy_refs(policies: DataFrame) -> DataFrame:
    refs = spread(policies).select("policy", F.posexplode_outer(context_references(F.col("content"))).alias("ref_ord", "ref"))
    return materialise(refs.where(F.col("ref").isNotNull()))


def _sweep(spans: Iterable[dict]) -> list[tuple[int, int, int]]:
    """Disjoint intervals that cover the same places, each with the smallest ``ref_ord`` over it."""
    events = sorted(
        [(s["first"], 0, s["ref_ord"]) for s in spans] + [(s["last"] + 1, 1, s["ref_ord"]) for s in spans]
    )
    alive: dict[int, int] = {}
    heap: list[int] = []
    out: list[tuple[int, int, int]] = []
    at = None
    for place, ends, o in events:
        while heap and not alive.get(heap[0]):
            heapq.heappop(heap)
        if heap and place > at:
            # A span goes on where the one before it has the same reference.
            if out and out[-1][2] == heap[0] and out[-1][1] == at - 1:
                out[-1] = (out[-1][0], place - 1, heap[0])
            else:
                out.append((at, place - 1, heap[0]))
        at = place
        alive[o] = alive.get(o, 0) + (-1 if ends else 1)
        if not ends:
            heapq.heappush(heap, o)
    return out


def policy_intervals(policies: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per policy the disjoint intervals that its references cover, ``policy, first, last, ref_ord``, and their dictionary.

    ``ref_ord`` is the first reference over the interval. A group holds the references of one policy, never sections.
    """
    refs = _policy_refs(policies)
    by_ref, words = reference_intervals(refs, index)
    spans = refs.join(by_ref, "ref").select("policy", "first", "last", "ref_ord")

    # One row a policy with the intervals of its references, and batches of policies, as a Python group for each would cost far more.
    @F.pandas_udf("array<struct<first:long,last:long,ref_ord:int>>")
    def disjoint(spans: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("first", "last", "ref_ord"), s)) for s in _sweep(x)] for x in spans])

    held = spans.groupBy("policy").agg(F.collect_list(F.struct("first", "last", "ref_ord")).alias("spans"))
    # The outer form keeps the optimiser from sweeping twice.
    return held.select("policy", F.explode_outer(disjoint("spans")).alias("s")).select("policy", "s.*"), words


def policy_sections(policies: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct sections per policy with their position: reference order, then index order.

    ``policies(policy, content)``. Policies hold intervals until the end, and a section is met at most once by its
    id and once by its chapter; the position comes from a sortable key, so a policy's sections are never collected.
    """
    spans, words = policy_intervals(policies, index)
    found = _sections_in(spans, words)
    # A section met both by its id and by its chapter has two places.
    return found.groupBy("policy", "section_id").agg(F.min("ref_ord").alias("ref_ord"))


def referenced_sections(policies: DataFrame, index: DataFrame) -> DataFrame:
    """Sections that some policy references, each once: intervals of the distinct references, with no row for each policy."""
    spans, words = reference_intervals(_policy_refs(policies).select("ref"), index)
    return _sections_in(spans.select("first", "last").distinct(), words).distinct()


def is_core(section_id: Column, module: Column | None = None, modules: Sequence[str] = fixed.CORE_MODULES) -> Column:
    """Core section: no schedule, transitional provision or appendix, and of an allowed module."""
    core = F.lit(True)
    for fragment in fixed.NON_CORE_FRAGMENTS:
        core = core & ~section_id.contains(fragment)
    return core if module is None else core & module.isin(list(modules))


def section_pool(index: DataFrame, referenced: DataFrame, supplementary: Sequence[str] = fixed.SUPPLEMENTARY_SECTIONS) -> DataFrame:
    """Core sections that a policy references or the supplement lists."""
    wanted = referenced.select("section_id").unionByName(
        index.where(F.col("section_id").isin(list(supplementary))).select("section_id")
    ).distinct()
    return index.where(is_core(F.col("section_id"), F.col("module"))).join(wanted, "section_id", "left_semi")


def cross_module_pairs(
    pool: DataFrame, target: int, pairs: Sequence[tuple[str, str]] = fixed.PRIORITY_MODULE_PAIRS,
    per_pair: int = fixed.PAIRS_PER_MODULE_PAIR,
) -> DataFrame:
    """Ordered section pairs of prioritised module pairs: ``position, section_a, section_b``.

    Only the first ``per_pair`` sections of a module can appear, so each side is
    limited before the join; what remains is at most a few rows per module pair.
    """
    spark = pool.sparkSession
    first = Window.partitionBy("module").orderBy("section_id")
    heads = materialise(
        pool.select("module", "section_id").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_pair)
    )
    plan = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, module_a string, module_b string")
    a = heads.select(F.col("module").alias("module_a"), F.col("section_id").alias("section_a"))
    b = heads.select(F.col("module").alias("module_b"), F.col("section_id").alias("section_b"))
    joined = F.broadcast(plan).join(a, "module_a").join(b, "module_b")
    each = Window.partitionBy("pair").orderBy("section_a", "section_b")
    kept = joined.withColumn("_r", F.row_number().over(each)).where(F.col("_r") <= per_pair)
    # At most len(pairs) * per_pair rows are numbered here.
    order = Window.orderBy("pair", "section_a", "section_b")
    return kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= target).select(
        "position", "module_a", "module_b", "section_a", "section_b"
    )
