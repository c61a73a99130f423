"""Graph reads over ``nodes`` and ``edges``: backlinks, bounded traversal, redirects, loose ends.

Single-id reads push their id into the scan. Batched reads take a table of start ids and carry it through every step, so
many questions cost one pass a level. Levels are cut with a reliable checkpoint, which bounds the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.runtime import broadcast_if_small, cut, numbered, written


def backlinks(nodes: DataFrame, edges: DataFrame, id: str, type: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes with an edge to ``id``, one row an edge: ``id type path ref_type line``, by id and line. Redirects are not followed."""
    inbound = edges.where(F.col("to_id") == id).select("from_id", "ref_type", "line")
    referrers = nodes.select("id", "type", "path") if type is None else nodes.where(F.col("type") == type).select("id", "type", "path")
    rows = inbound.join(referrers, F.col("from_id") == F.col("id")).select("id", "type", "path", "ref_type", "line").orderBy("id", "line", "ref_type")
    return rows if limit is None else rows.limit(limit)


def backlink_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, n)``: for every target, its edges from existing nodes. Edges are counted map-side before the shuffle."""
    pairs = edges.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.sum("n").alias("n"))


def outbound(edges: DataFrame, id: str) -> DataFrame:
    """Edges from ``id`` in the order of their lines: ``to_id ref_type line``."""
    return edges.where(F.col("from_id") == id).select("to_id", "ref_type", "line").orderBy("line", "to_id", "ref_type")


def traverse(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Nodes within ``depth`` hops of each start: ``start id type path ref_type line distance``.

    Breadth first; the first discovery counts (parents in their own order, then line, target, sequence) and gives the
    reference. Targets that are no node are remembered but neither returned nor followed; a start is never returned.
    One checkpoint a level but the last; a level is ranked by a distributed sort, so that one start with a large level
    needs no task of its own.
    """
    order = F.col("seq") if "seq" in edges.columns else F.lit(0)
    steps = edges.select("from_id", "to_id", "ref_type", "line", order.alias("seq"))
    known = nodes.select("id", "type", "path")
    starts = starts.select(F.col("id").alias("start")).distinct()
    frontier = starts.select("start", F.col("start").alias("from_id"), F.lit(0).cast("long").alias("rank"))
    seen = starts.select("start", F.col("start").alias("to_id"))
    found = None
    for distance in range(1, depth + 1):
        reached = broadcast_if_small(frontier, 50_000).join(steps, "from_id")
        first = F.min(F.struct("rank", "line", F.col("to_id").alias("to"), "seq", "ref_type")).alias("b")
        fresh = reached.groupBy("start", "to_id").agg(first).join(seen, ["start", "to_id"], "left_anti")
        fresh = fresh.join(known, fresh["to_id"] == known["id"], "left")
        fresh = fresh.select("start", "to_id", "id", "type", "path", "b.ref_type", "b.line", F.lit(distance).alias("distance"), "b.rank", "b.seq")
        last = distance == depth
        if not last:
            ordered = fresh.orderBy("start", "rank", "line", "to_id", "seq")
            fresh = cut(ordered.withColumn("rank", F.monotonically_increasing_id()))
        level = fresh.where("id IS NOT NULL")
        shown = level.select("start", "id", "type", "path", "ref_type", "line", "distance")
        found = shown if found is None else found.unionByName(shown)
        if last or level.isEmpty():
            break
        seen = seen.unionByName(fresh.select("start", "to_id"))
        frontier = level.select("start", F.col("id").alias("from_id"), "rank")
    if found is None:
        found = starts.join(known, starts["start"] == known["id"]).where("false").select("start", "id", "type", "path", F.lit("").alias("ref_type"), F.lit(0).alias("line"), F.lit(0).alias("distance"))
    return found


def reach(nodes: DataFrame, edges: DataFrame, type: str, depth: int = 1) -> DataFrame:
    """Every node with the other nodes of ``type`` within ``depth`` hops of it: ``start id type path distance``.

    The rows that ``traverse`` from all nodes has of that type, without their references: the way there may lead over nodes
    of any type. The walk goes backwards from the nodes of the type, so that what never meets one is not built. Nodes go
    by dense numbers. What a node is within reach of crosses as one array a link, a number for each target and its distance;
    a start's arrays are sorted together, the first number of a target counts, and only then they become rows. Rows of pairs
    are never kept, and shuffled only for their names where the targets are too many for a broadcast.
    """
    known, count = numbered(nodes.select("id", "type", "path"))
    span = depth + 1
    number = "int" if count * span < 1 << 31 else "long"
    known = known.withColumn("ix", F.col("ix").cast(number))
    side = lambda id, ix: known.select(F.col("id").alias(id), F.col("ix").alias(ix)).hint("shuffle_hash")
    ends = edges.select("from_id", "to_id").where("from_id <> to_id").distinct()
    links = written(ends.join(side("from_id", "f"), "from_id").join(side("to_id", "t"), "to_id").select("f", "t"), "links")
    targets = known.where(F.col("type") == type)
    own = targets.select(F.col("ix").alias("t"), F.array((F.col("ix") * span).cast(number)).alias("codes"))
    first = f"f <> code div {span} AND (i = 0 OR code div {span} <> get(codes, i - 1) div {span})"
    within, sets = own, None
    for distance in range(1, depth + 1):
        sets = links.join(within, "t").groupBy("f").agg(F.sort_array(F.flatten(F.collect_list("codes"))).alias("codes"))
        if distance < depth:
            # outer: no array is empty, and no filter on its size is planned that would sort it twice
            pairs = sets.select("f", "codes", F.posexplode_outer("codes").alias("i", "code")).where(first)
            within = written(pairs.groupBy(F.col("f").alias("t")).agg(F.collect_list((F.col("code") + 1).cast(number)).alias("codes")), "within").unionByName(own)
    if sets is None:
        return known.where("false").select(F.col("id").alias("start"), "id", "type", "path", F.lit(0).alias("distance"))
    pairs = sets.join(side("start", "f"), "f").select("f", "start", "codes", F.posexplode_outer("codes").alias("i", "code")).where(first)
    pairs = pairs.select("start", F.expr(f"code div {span}").cast(number).alias("target"), (F.col("code") % span + 1).cast("int").alias("distance"))
    rows = pairs.join(broadcast_if_small(targets.withColumnRenamed("ix", "target")), "target")
    return rows.select("start", "id", "type", "path", "distance")


def refs(nodes: DataFrame, edges: DataFrame, id: str, depth: int = 1, type: str | None = None) -> DataFrame:
    """Nodes that ``id`` references within ``depth`` hops, by distance and id. The type filter comes after the traversal."""
    rows = traverse(nodes, edges, nodes.sparkSession.createDataFrame([(id,)], "id string"), depth).drop("start")
    return (rows if type is None else rows.where(F.col("type") == type)).orderBy("distance", "id")


def redirect(col: Column | str = "superseded_by") -> Column:
    """A node's redirect target; empty text is none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != "", c)


def _chase(hops: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Where every ``at`` of ``hops (at, next)`` ends: ``(at, end)`` of the chains that leave ``hops``, and ``(at, far)`` of
    those that never do, ``far`` a member of their cycle (None where there are none).

    Pointer doubling: after ``n`` rounds a pointer spans ``2 ** n`` hops. While some chain still ends, every round ends one,
    so a round that ends none leaves cycles only; these go on until a pointer spans more hops than there are members.
    """
    jump, before, span = written(hops.select("at", "next"), "hops"), -1, 1
    while True:
        far = broadcast_if_small(jump.select(F.col("at").alias("next"), F.col("next").alias("far")))
        jump = written(jump.select("at", "next").join(far, "next", "left").select("at", F.coalesce("far", "next").alias("next"), F.col("far").isNotNull().alias("on")), "hops")
        still, span = jump.where("on").count(), 2 * span
        if not still:
            return jump.select("at", F.col("next").alias("end")), None
        if still == before and span > still:
            return jump.where("NOT on").select("at", F.col("next").alias("end")), jump.where("on").select("at", F.col("next").alias("far"))
        before = still


def chain_ends(hops: DataFrame) -> DataFrame:
    """``(at, end)``: where each chain of ``hops (at, next)`` ends; a chain that runs into a cycle ends where it enters it."""
    ends, round_ = _chase(hops)
    if round_ is None:
        return ends
    members = written(round_.select(F.col("far").alias("at")).distinct())
    into = round_.select("at").join(members, "at", "left_anti").join(hops, "at")
    return ends.unionByName(members.select("at", F.col("at").alias("end"))).unionByName(_chase(into)[0])


def resolve_all(nodes: DataFrame, requested: DataFrame) -> DataFrame:
    """Follow redirects of every requested id: ``requested resolved missing``.

    ``resolved`` is the node where the chain ends - on a cycle, the node where it repeats; ``missing`` the first id of the
    chain that is no node (``resolved`` is null then). Chains run over the redirecting nodes alone, in as many rounds as the
    logarithm of the longest; whether an end exists is one join with all nodes.
    """
    hops = nodes.select(F.col("id").alias("at"), redirect().alias("next")).where("next IS NOT NULL")
    asked = requested.select(F.col("id").alias("at")).where("at IS NOT NULL").distinct()
    ends = asked.join(broadcast_if_small(chain_ends(hops)), "at", "left").select(F.col("at").alias("requested"), F.coalesce("end", "at").alias("end"))
    there = nodes.select(F.col("id").alias("end"), F.lit(True).alias("there"))
    rows = ends.join(there, "end", "left")
    return rows.select("requested", F.when(F.col("there"), F.col("end")).alias("resolved"), F.when(F.col("there").isNull(), F.col("end")).alias("missing"))


def resolve(nodes: DataFrame, id: str) -> DataFrame:
    """``id requested_id superseded_by type path frontmatter`` of the node ``id`` stands for; no row where none does."""
    asked = nodes.sparkSession.createDataFrame([(id,)], "id string")
    ends = resolve_all(nodes, asked).where("resolved IS NOT NULL")
    rows = broadcast_if_small(ends).join(nodes, F.col("resolved") == F.col("id"))
    moved = F.when(F.col("requested") != F.col("id"), F.col("id"))
    return rows.select("id", F.when(moved.isNotNull(), F.col("requested")).alias("requested_id"), moved.alias("superseded_by"), "type", "path", "frontmatter")


def scope_members(edges: DataFrame, scope: str, scope_field: str = "scope") -> DataFrame:
    """Ids of the nodes that have an edge of type ``scope_field`` to ``scope``."""
    return edges.where((F.col("ref_type") == scope_field) & (F.col("to_id") == scope)).select(F.col("from_id").alias("id")).distinct()


def unresolved(loose: DataFrame, edges: DataFrame | None = None, type: str | None = None, scope: str | None = None, scope_field: str = "scope") -> DataFrame:
    """Loose ends by file and line: ``record path type_guess descriptor line``, of a guessed type or a scope's members."""
    rows = loose if type is None else loose.where(F.col("type_guess") == type)
    if scope is not None:
        rows = rows.join(scope_members(edges, scope, scope_field), F.col("record_id") == F.col("id"), "left_semi")
    return rows.select(F.col("record_id").alias("record"), F.col("source_file").alias("path"), "type_guess", "descriptor", "line").orderBy("path", "line", "descriptor")


def status_counts(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: ``nodes edges sections``."""
    parts = [t.select(F.lit(n).alias("what")) for n, t in (("nodes", nodes), ("edges", edges), ("sections", embeddings))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.agg(*(F.coalesce(F.sum((F.col("what") == n).cast("long")), F.lit(0)).alias(n) for n in ("nodes", "edges", "sections")))


def count_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy("type")
