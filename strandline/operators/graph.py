"""Bounded breadth-first traversal over undirected, typed edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .lookup import PUSHED


def _typed(relationships: DataFrame, types: list[str] | None) -> DataFrame:
    return relationships.where(F.col("type").isin(types)) if types else relationships


def _touching(rel: DataFrame, frontier: DataFrame, few: list[str] | None) -> DataFrame:
    """The relationships with an end in ``frontier`` (distinct ids), and which ends are: ``_s``, ``_t``.

    The ids ``few`` go into the scan by value, so relationships are read once and neither written nor shuffled; without them the ends are joined."""
    if few is not None:
        marked = rel.withColumns({"_s": F.coalesce(F.col("source_id").isin(few), F.lit(False)), "_t": F.coalesce(F.col("target_id").isin(few), F.lit(False))})
        return marked.where(F.col("source_id").isin(few) | F.col("target_id").isin(few))
    ids = frontier.select(F.col("id").alias("_id"), F.lit(True).alias("_in"))
    for end, flag in (("source_id", "_s"), ("target_id", "_t")):
        rel = rel.join(ids, F.col(end) == F.col("_id"), "left").withColumn(flag, F.coalesce("_in", F.lit(False))).drop("_id", "_in")
    return rel.where("_s OR _t")


def _walk(rel: DataFrame, start: str, depth: int, keep: bool) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """(id, level) of everything within ``depth`` hops; and, to ``keep`` them, each explored level's nodes and the relationships at them.

    A level reads the relationships once.  A frontier is written before it is used again, so plans don't
    grow with the depth and its size is known to the planner.  A null end is no node."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    seen = frontier = rel.sparkSession.createDataFrame([(start, 0)], "id string, level int")
    few, explored = [start], []
    for level in range(1, depth + 1):
        at = _touching(rel, frontier, few)
        if keep:
            at = staged(at, "explored")
            explored.append((frontier, at))
        ends = F.array(F.when(F.col("_s"), F.col("target_id")), F.when(F.col("_t"), F.col("source_id")))
        reached = at.select(F.explode(ends).alias("id")).where("id IS NOT NULL").distinct()
        frontier = staged(reached.join(seen, "id", "left_anti").withColumn("level", F.lit(level)), "frontier")
        seen = seen.union(frontier)
        if level < depth:
            found = [r["id"] for r in frontier.select("id").limit(PUSHED + 1).collect()]
            if not found:
                break
            few = found if len(found) <= PUSHED else None
    return seen, explored


def levels(relationships: DataFrame, start: str, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """(id, level) of everything within ``depth`` hops of ``start``."""
    return _walk(_typed(relationships, types).select("source_id", "target_id"), start, depth, False)[0]


def traverse(entities: DataFrame, relationships: DataFrame, start: str, depth: int = 1, types: list[str] | None = None, edge_multiplicity: str = "set") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges).  Nodes carry their ``level``.  An edge is returned if one of its ends
    was explored (level < depth): once, or with ``edge_multiplicity='reference'`` once per
    explored end.  An unknown start is an error."""
    if entities.where(F.col("id") == start).isEmpty():
        raise LookupError(f"no entity {start!r}")
    rel = _typed(relationships, types)
    reach, explored = _walk(rel, start, depth, True)
    nodes = entities.join(reach, "id")
    given, before = [rel.limit(0)], None
    for frontier, at in explored:
        if edge_multiplicity == "reference":
            times = F.col("_s").cast("int") + (F.col("_t") & ~F.col("source_id").eqNullSafe(F.col("target_id"))).cast("int")
            at = at.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n")
        elif before is not None:
            # An edge from the level before was given there.
            other = F.when(~F.col("_t"), F.col("target_id")).when(~F.col("_s"), F.col("source_id"))
            at = at.withColumn("_other", other).join(before.select(F.col("id").alias("_other")), "_other", "left_anti").drop("_other")
        given.append(at.drop("_s", "_t"))
        before = frontier
    return nodes, reduce(DataFrame.unionByName, given[1:] or given)


#: Starts that travel together: the bits of a long.
GROUP = 64
#: Nodes whose one neighbour has so many of that kind are its leaves and stay outside the traversal.
LEAVES = 256
#: Starts among the leaves of a node are lists of some ``NAMES``; ``RECEIVERS`` nodes that a list reaches, at most some ``ROWS`` rows, are one task's at once.
NAMES, RECEIVERS, ROWS = 1 << 12, 1 << 13, 1 << 26


def _leaves(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(hub, leaf, starts) of all leaves and (hub, n, n_starts) of their hubs; None without any.

    A leaf has one neighbour.  Of two nodes that only have each other the larger is the leaf."""
    one = edges.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 1")
    pairs = one.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("a").alias("leaf"))
    pairs = pairs.select("leaf", F.when(F.col("leaf") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("hub"))
    marked = staged(pairs.join(ids.select(F.col("id").alias("leaf"), F.lit(True).alias("starts")), "leaf", "left"), "leaves")
    hubs = staged(marked.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.count("starts").alias("n_starts")).where(F.col("n") >= LEAVES), "hubs")
    return None if hubs.isEmpty() else (marked.join(hubs, "hub").select("hub", "leaf", F.coalesce("starts", F.lit(False)).alias("starts"), "n_starts"), hubs)


def _from_leaves(found: DataFrame, numbered: DataFrame, leaves: DataFrame, hubs: DataFrame, depth: int) -> DataFrame:
    """(start, id, level) of the starts that are leaves, from what their hubs reached (``found``).

    A leaf is one hop behind its hub, as a start and as a node, and itself at none.  What meets a node is a whole list of starts.
    Lists and the nodes that they reach are dealt by (list, slice), so the rows of a task stay few for any hub, and a list becomes rows last."""
    part = F.pmod(F.xxhash64("leaf"), (F.col("n_starts") / NAMES).cast("long") + 1)
    lists = leaves.where("starts").groupBy("hub", part.alias("part")).agg(F.collect_list("leaf").alias("names"))
    lists = staged(lists.select(F.concat_ws(":", F.col("part").cast("string"), "hub").alias("list"), "hub", "names", F.size("names").alias("size")), "lists")
    at = lists.select("list", "hub", "size").join(numbered.select(F.col("start").alias("hub"), "grp", "bit"), "hub").drop("hub")
    met = found.where(F.col("level") < depth).join(at, "grp").where("getbit(mask, bit) = 1").select("id", "list", "size", "level")
    met = staged(met, "met")
    # How many nodes a list reaches, before they are rows.
    each = met.join(hubs.select(F.col("hub").alias("id"), "n"), "id", "left").select("list", "size", (1 + F.when(F.col("level") < depth - 1, F.coalesce("n", F.lit(0))).otherwise(0)).alias("n"))
    dealt = staged(each.groupBy("list").agg(F.first("size").alias("size"), (F.sum("n") / RECEIVERS).cast("long").alias("last"), F.sum("n").alias("n")), "dealt")
    total = dealt.agg(F.sum(F.col("size").cast("double") * F.col("n"))).first()[0] or 0
    n = min(10_000, int(total / ROWS) + int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    behind = met.where(F.col("level") < depth - 1).withColumnRenamed("id", "hub").join(leaves, "hub")
    receivers = met.select("id", "list", (F.col("level") + 1).alias("level"), F.lit(False).alias("own"))
    receivers = receivers.union(behind.select("leaf", "list", F.col("level") + 2, F.col("starts") & (F.col("level") == 0)))
    receivers = receivers.join(dealt.select("list", "last"), "list").select("list", F.pmod(F.xxhash64("id"), F.col("last") + 1).alias("slice"), "id", "level", "own")
    lists = lists.select("list", "names").join(dealt.select("list", "last"), "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("slice"), "names")
    both = receivers.repartition(n, "list", "slice").join(lists.repartition(n, "list", "slice").hint("merge"), ["list", "slice"])
    names = F.when(F.col("own"), F.array_remove("names", F.col("id"))).otherwise(F.col("names"))
    return both.select(F.explode(names).alias("start"), "id", "level").unionByName(leaves.where("starts").select(F.col("leaf").alias("start"), F.col("leaf").alias("id"), F.lit(0).alias("level")))


def traverse_many(relationships: DataFrame, starts: DataFrame, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """(start, id, level) of everything within ``depth`` hops of each of ``starts`` (column ``id``).

    Starts are numbered, and 64 of them, neighbours of one node where there are so many, are the bits of a mask.  A level is one join for all starts: a node hands
    its new bits to its neighbours, a bitwise OR gathers them, and the bits a node has had are taken away, so
    paths of different starts over one edge are one row.  The leaves of nodes with many of them take no part:
    what their hub reached, they reach a hop later.  A start that repeats counts once; a null is none."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    spark = relationships.sparkSession
    rel = _typed(relationships, types).select("source_id", "target_id")
    edges = rel.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(rel.select("target_id", "source_id")).where("a <> b").distinct()
    edges = staged(edges, "edges") if depth else spark.createDataFrame([], "a string, b string")
    ids = starts.select("id").where("id IS NOT NULL").distinct()
    ids = staged(ids, "ids") if depth else ids
    leaves, hubs = (_leaves(edges, ids) if depth else None) or (None, None)
    ids = ids.withColumn("own", F.lit(True))
    if leaves is not None:
        gone = leaves.select(F.col("leaf").alias("a"), F.col("hub").alias("b"))
        edges = staged(edges.join(gone.union(gone.select("b", "a")), ["a", "b"], "left_anti"), "edges")
        # A hub goes for its leaves, if some are starts.
        ids = ids.join(leaves.select(F.col("leaf").alias("id")), "id", "left_anti").union(hubs.where("n_starts > 0").select("hub", F.lit(False))).groupBy("id").agg(F.max("own").alias("own"))
    # Starts with a common neighbour are numbered together: they reach the same nodes, so a node has few groups and
    # full masks.  A task's own numbers are gapless, so no window over all starts is needed.
    near = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
    placed = ids.join(near, "id", "left").repartitionByRange("near", "id").sortWithinPartitions("near", "id")
    numbered = staged(placed.select("id", "own", F.monotonically_increasing_id().alias("_at")), "starts")
    numbered = numbered.select(F.col("id").alias("start"), "own", F.shiftright("_at", 6).alias("grp"), F.col("_at").bitwiseAND(GROUP - 1).cast("int").alias("bit"))
    frontier = staged(numbered.select(F.col("start").alias("id"), "grp", F.expr("shiftleft(1L, bit)").alias("mask")), "frontier")
    found = [frontier.withColumn("level", F.lit(0))]
    for level in range(1, depth + 1):
        handed = frontier.select(F.col("id").alias("a"), "grp", "mask").join(edges, "a").select(F.col("b").alias("id"), "grp", "mask", F.lit(0).cast("long").alias("had"))
        for known in found:
            handed = handed.unionByName(known.select("id", "grp", F.lit(0).cast("long").alias("mask"), F.col("mask").alias("had")))
        met = handed.groupBy("id", "grp").agg(F.bit_or("mask").alias("mask"), F.bit_or("had").alias("had"))
        frontier = met.select("id", "grp", F.expr("mask & ~had").alias("mask")).where("mask <> 0")
        if level < depth:  # the last one, most of the result, is read once and stays unwritten
            frontier = staged(frontier, "frontier")
        found.append(frontier.withColumn("level", F.lit(level)))
        if level < depth and frontier.isEmpty():
            break
    out = reduce(DataFrame.unionByName, found)
    if leaves is not None:
        written = reduce(DataFrame.unionByName, found[:depth])
        out = out.unionByName(written.withColumnRenamed("id", "hub").join(leaves, "hub").select(F.col("leaf").alias("id"), "grp", "mask", F.expr("level + 1 AS level")))
    # A group's names meet the masks, and only then masks become rows: what is shuffled are masks.
    names = numbered.where("own").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("bit", "start"))).alias("names"))
    mine = F.transform(F.filter("names", lambda s: F.getbit("mask", s["bit"]) == 1), lambda s: s["start"])
    # A plain explode would be put behind a filter that computes the list a second time.
    rows = out.join(names, "grp").select(F.explode_outer(mine).alias("start"), "id", "level").where("start IS NOT NULL")
    return rows if leaves is None else rows.unionByName(_from_leaves(written, numbered, leaves, hubs, depth))
