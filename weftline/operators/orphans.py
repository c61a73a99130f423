"""References to records that do not exist (problem 5).

A fixpoint cascade over a foreign-key graph. Direct orphans are references whose record is ``missing`` (no row has the
id), ``deleted`` (rows have it, all deleted) or ``late`` (a live row exists, but the earliest row of the id came after the
reference). Records whose own parent reference is missing or deleted are orphaned records; records below them are added
by semi-joins until nothing changes, and references to orphaned records are reported as ``inherited``.

Scale: the parent table is reduced to one row an id with map-side combining, references keep only four narrow columns.
One parent may hold a third of all references: references are counted by parent (combined before the shuffle), and the
parents with more than ``HOT`` of them - and only these - are repeated ``SALT`` times, their references spread over the
copies. Rows delivered twice are dropped among the findings, not in the whole table. Cascade rounds touch parents only,
each round is one reliable checkpoint, and they end when a round finds nothing new.

Defined results
    * null and blank references are no cases; outer white space is not part of a reference, case and scope are.
    * a reference without a time is never ``late`` and its period is null; parents without a time count as always there.
    * cycles of parents end the cascade as nothing new is found; an empty parent table makes every reference missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.runtime import broadcast_if_small, small_enough, written

#: References from which a parent is hot, and how often it is then repeated so that its references spread over as many tasks.
HOT, SALT = 500_000, 32
#: Links up to which one task may end a deep cascade (some 100 MB of ids).
LOCAL_LINKS = 500_000
#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def references(df: DataFrame, table: str, row_id: str, ref: str, at: str = "indexed_at") -> DataFrame:
    """The non-blank references of a table as ``(table_name, row_id, ref, at)``, outer white space removed."""
    trimmed = F.trim(F.col(ref), F.lit(WHITE))
    rows = df.select(F.lit(table).alias("table_name"), F.col(row_id).cast("bigint").alias("row_id"), trimmed.alias("ref"), F.col(at).cast("timestamp_ntz").alias("at"))
    return rows.where("ref <> ''")


def parent_states(parents: DataFrame, key: str = "id", at: str = "indexed_at", deleted: str = "deleted_at") -> DataFrame:
    """One row an id: ``(ref, alive, first)`` - whether any row is live, and the earliest time of all its rows."""
    return (
        parents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("ref"))
        .agg(F.max(F.col(deleted).isNull()).alias("alive"), F.min(F.col(at).cast("timestamp_ntz")).alias("first"))
    )


def with_kind(refs: DataFrame, states: DataFrame, hot_rows: int = HOT, salt: int = SALT) -> DataFrame:
    """``refs`` with ``kind``: ``missing``, ``deleted``, ``late`` or null where the record is there."""
    hot = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("ref")
    kind = F.when(F.col("alive").isNull(), "missing").when(~F.col("alive"), "deleted").when(F.col("first") > F.col("at"), "late")
    # at most rows / hot_rows parents are hot, so they are asked for once and then travel as a short list
    names = [r["ref"] for r in hot.collect()] if hot_rows else []
    if not names:
        return refs.join(states, "ref", "left").withColumn("kind", kind).drop("alive", "first")
    listed = F.broadcast(refs.sparkSession.createDataFrame([(n, salt) for n in names], "ref string, copies int"))
    spread = states.join(listed, "ref", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    salted = refs.join(listed, "ref", "left").withColumn("salt", F.coalesce(F.pmod(F.hash("row_id", "at"), "copies"), F.lit(0))).drop("copies")
    return salted.join(spread, ["ref", "salt"], "left").withColumn("kind", kind).drop("salt", "alive", "first")


def orphaned_parents(states: DataFrame, links: DataFrame, local_from: int = 8) -> DataFrame:
    """``(ref, depth)``: live parents that hang, over ``links (child, parent)``, on a missing or deleted record.

    Depth 1 hangs on it directly. Each round semi-joins the remaining links with what the last one found, until a round finds
    nothing new; a record is found once, so cycles end too. From depth ``local_from`` on, when no more than ``LOCAL_LINKS``
    links remain, one task runs the remaining rounds.
    """
    alive = states.where("alive").select("ref")
    links = links.where("child IS NOT NULL AND parent IS NOT NULL AND parent <> '' AND child <> parent").distinct()
    links = links.join(alive.withColumnRenamed("ref", "child"), "child", "left_semi")
    links = written(links.join(alive.select(F.col("ref").alias("parent"), F.lit(True).alias("held")), "parent", "left"), "links")
    newest = written(links.where("held IS NULL").select(F.col("child").alias("ref")).distinct().withColumn("depth", F.lit(1)), "orphans")
    below, found, rest, depth = links.where("held").select("parent", "child"), None, None, 1
    while not newest.isEmpty():
        found = newest if found is None else found.unionByName(newest)
        if depth % 8 == 0:  # one frame again, and only the links of records that are not found yet
            found = written(found, "orphans")
            below = written(below.join(found.select(F.col("ref").alias("child")), "child", "left_anti"), "links")
            if depth >= local_from and small_enough(below, LOCAL_LINKS):
                return found.unionByName(_cascade_on(below, newest, depth))
        depth += 1
        last = broadcast_if_small(newest.select(F.col("ref").alias("parent")))
        children = below.join(last, "parent", "left_semi").select(F.col("child").alias("ref")).distinct()
        newest = written(children.join(found.select("ref"), "ref", "left_anti").withColumn("depth", F.lit(depth)), "orphans")
    return found if found is not None else newest


def _cascade_on(below: DataFrame, newest: DataFrame, depth: int) -> DataFrame:
    """The rounds after ``depth`` over the remaining links, a checked number, in one task: a long thin chain would cost a job
    for every record of it."""

    def run(links: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(links)
        whole = pd.concat(parts) if parts else pd.DataFrame({"parent": [], "child": []})
        children = whole[whole["parent"].notna()].groupby("parent")["child"].agg(list).to_dict()
        level, d, out = list(whole[whole["parent"].isna()]["child"]), depth, {}
        while level:
            d += 1
            level = [c for c in dict.fromkeys(c for p in level for c in children.get(p, ())) if c not in out]
            out.update(dict.fromkeys(level, d))
        yield pd.DataFrame({"ref": list(out), "depth": list(out.values())})

    starts = newest.select(F.lit(None).cast("string").alias("parent"), F.col("ref").alias("child"))
    return written(below.select("parent", "child").unionByName(starts).coalesce(1).mapInPandas(run, "ref string, depth int"), "orphans")


def find_orphans(refs: Iterable[DataFrame], parents: DataFrame, links: DataFrame, hot_rows: int = HOT, salt: int = SALT) -> DataFrame:
    """Every orphaned reference as ``(table_name, row_id, period, kind, origin, depth)``.

    ``origin`` is ``direct`` (depth 0) or ``inherited``, the latter with kind ``inherited`` and the depth of the record the
    reference hangs on.
    """
    every = None
    for r in refs:
        every = r if every is None else every.unionByName(r)
    states = written(parent_states(parents), "parents")
    inherited = orphaned_parents(states, links)
    judged = with_kind(every, states.join(inherited.withColumnRenamed("depth", "below"), "ref", "left"), hot_rows, salt)
    kind = F.coalesce("kind", F.when(F.col("below").isNotNull(), "inherited"))
    origin = F.when(F.col("kind").isNotNull(), "direct").otherwise("inherited")
    depth = F.when(F.col("kind").isNotNull(), 0).otherwise(F.col("below"))
    rows = judged.where("kind IS NOT NULL OR below IS NOT NULL")
    return rows.select("table_name", "row_id", F.date_format("at", "yyyy-MM").alias("period"), kind.alias("kind"), origin.alias("origin"), depth.alias("depth")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts by table, period, kind and origin."""
    return found.groupBy("table_name", "period", "kind", "origin").agg(F.count(F.lit(1)).alias("n"))
