"""Graphs of record pairs: components, groups, one-to-one matching, greedy group linking and refinement."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergekin.functions.maths import hash_longs
from mergekin.session import drop, stash


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(v, component): vertices of an undirected graph with the least vertex of their component.

    Alternating large-star and small-star rewrites: every round is a keyed aggregate and a join, and the number of rounds is
    logarithmic.  Null ends are dropped with their edge; a loop makes its vertex a component.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    vertices = pairs.select(F.col("a").alias("v")).unionAll(pairs.select("b")).distinct()
    e = stash(pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        arcs = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        low = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        old, e = e, stash(arcs.join(low, "u").where("v > u and v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large")
        drop(old)
        low = e.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        hung = e.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u").select("v", "m").unionAll(low.select("u", "m"))
        old, e = e, stash(hung.where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "small")
        drop(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return vertices.join(e.select(F.col("b").alias("v"), F.col("a").alias("root")), "v", "left").select("v", F.coalesce("root", "v").alias("component"))


def group_stats(nodes: DataFrame, group: str = "group_id", sim: str = "sim") -> DataFrame:
    """(group_id, size, avg_sim)."""
    return nodes.groupBy(F.col(group).alias("group_id")).agg(F.count("*").alias("size"), F.avg(sim).alias("avg_sim"))


def size_histogram(stats: DataFrame) -> DataFrame:
    return stats.groupBy("size").agg(F.count("*").alias("groups"))


def trimmed_groups(nodes: DataFrame, merge_t: float, group: str = "group_id", sim: str = "sim", key: list[str] | None = None) -> DataFrame:
    """The longest prefix of each group, best nodes first, whose mean is at least merge_t; none shorter than two nodes.

    Dropping the worst node until the mean suffices is a running mean; ties go by the key columns.
    """
    key = key or ["r1", "r2"]
    order = Window.partitionBy(group).orderBy(F.desc(sim), *key)
    ranked = nodes.withColumn("_mean", F.avg(sim).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(order))
    best = ranked.groupBy(group).agg(F.max(F.when(F.col("_mean") >= merge_t, F.col("_rank"))).alias("_keep"))
    return ranked.join(best, group).where((F.col("_keep") >= 2) & (F.col("_rank") <= F.col("_keep"))).drop("_mean", "_rank", "_keep")


def one_to_one(pairs: DataFrame, score: str = "sim", left: str = "r1", right: str = "r2") -> DataFrame:
    """Greedy one-to-one matching by falling score, ties by the pair: rounds of locally dominant pairs, exactly the sequential result.

    In each round a pair that is the best of both its records is taken and all other pairs of the two go.
    """
    rest = stash(pairs.select(F.col(left).alias("l"), F.col(right).alias("r"), F.col(score).alias("s")).where("l is not null and r is not null").groupBy("l", "r").agg(F.max("s").alias("s")), "pairs")
    taken = None
    while not rest.isEmpty():
        rank = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("s"), "l", "r"))
        best = stash(rest.withColumn("kl", rank("l")).withColumn("kr", rank("r")).where("kl = 1 and kr = 1").select("l", "r", "s"), "taken")
        taken = best if taken is None else taken.unionByName(best)
        old, rest = rest, stash(rest.join(best.select("l"), "l", "left_anti").join(best.select("r"), "r", "left_anti"), "pairs")
        drop(old)
    taken = rest if taken is None else taken
    return taken.select(F.col("l").alias(left), F.col("r").alias(right), F.col("s").alias(score))


def _blocks_of_two(left: DataFrame, right: DataFrame, block: str, place: str, id_column: str) -> DataFrame:
    """(l, r): the records (id, at) of each block that has some on both sides."""
    of = lambda df, side: df.where(F.col(block).isNotNull() & F.col(place).isNotNull()).select(F.col(block).alias("b"), F.struct(F.col(id_column).cast("long").alias("id"), F.col(place).cast("long").alias("at")).alias(side))
    both = of(left, "l").withColumn("r", F.lit(None)).unionByName(of(right, "r").withColumn("l", F.lit(None)))
    return both.groupBy("b").agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r")).where((F.size("l") > 0) & (F.size("r") > 0)).select("l", "r")


def one_to_one_near(left: DataFrame, right: DataFrame, block: str, place: str, most: int, id_column: str = "id") -> DataFrame:
    """(r1, r2, gap): one_to_one() of all pairs within a block whose whole places are at most `most` apart, the nearest first, ties by the pair.

    The pairs are not formed: of a place the least free record is always the next to go, so a block costs as much as its records and not as its pairs,
    of which a block of many records has too many.  Ids are long and come once; records without block or place are left out.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: list[tuple[int, int, int]] = []
            for one, two in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                free: dict[int, deque] = {}
                for r in sorted(two, key=lambda r: r["id"]):
                    free.setdefault(r["at"], deque()).append(r["id"])
                rest = sorted((r["id"], r["at"]) for r in one)
                for gap in range(most + 1):
                    left_over = []
                    for r1, at in rest:
                        near = min((q for q in {at - gap, at + gap} if free.get(q)), key=lambda q: free[q][0], default=None)
                        if near is None:
                            left_over.append((r1, at))
                        else:
                            out.append((r1, free[near].popleft(), gap))
                    rest = left_over
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["r1", "r2", "gap"])

    return _blocks_of_two(left, right, block, place, id_column).mapInArrow(match, "r1 long, r2 long, gap long")


def singles_near(left: DataFrame, right: DataFrame, block: str, place: str, most: int, id_column: str = "id") -> DataFrame:
    """(r1, r2, gap): as one_to_one_near(), with the greedy linker's order of single pairs: the nearest first, then the lesser id of the two, then xxhash64(r1, r2).

    At a gap the records of both sides come by their ids, and each takes of the free ones so far away the one of least hash: none of those has a lesser
    id, as it would have taken a record before.  Ids are long and differ between the sides.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: list[tuple[int, int, int]] = []
            for one, two in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                records = sorted([(r["id"], r["at"], 0) for r in one] + [(r["id"], r["at"], 1) for r in two])
                free: tuple[dict[int, np.ndarray], ...] = ({}, {})
                for (side, at), some in groupby(sorted(records, key=lambda r: (r[2], r[1], r[0])), key=lambda r: (r[2], r[1])):
                    free[side][at] = np.array([r[0] for r in some], np.int64)
                gone: set[int] = set()
                for gap in range(most + 1):
                    for i, at, side in records:
                        near = [(q, free[1 - side][q]) for q in {at - gap, at + gap} if i not in gone and len(free[1 - side].get(q, ()))]
                        if not near:
                            continue
                        ids = near[0][1] if len(near) == 1 else np.concatenate([n for _, n in near])
                        taken = int(ids[0 if len(ids) == 1 else np.argmin(hash_longs(ids, i) if side else hash_longs(i, ids))])
                        gone |= {i, taken}
                        for q, n in near:
                            free[1 - side][q] = n[n != taken]
                        free[side][at] = free[side][at][free[side][at] != i]
                        out.append((taken, i, gap) if side else (i, taken, gap))
                    records = [r for r in records if r[0] not in gone]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["r1", "r2", "gap"])

    return _blocks_of_two(left, right, block, place, id_column).mapInArrow(match, "r1 long, r2 long, gap long")


# --- greedy group linking ----------------------------------------------------------------------------------------

Valid = Callable[[list[dict], dict[object, set]], bool]


def _clusters(parent: dict, x: object) -> object:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def link_component(pdf: pd.DataFrame, merge_t: float, singles_t: float | None, one_to_one_types: set[str], year_gap: int | None, strict: bool) -> pd.DataFrame:
    """The sequential linker on whole conflict components: groups by size, then mean, then least pair; each trimmed to the prefix that passes.

    Nodes are pairs (r1, r2) of a type; records of one-to-one types may be in one pair only.  Single nodes join if their score is at
    least singles_t (None: they are left out).  strict re-checks one-to-one inside a group as its nodes are merged.
    """
    rows = pdf.sort_values(["group_id", "sim", "r1", "r2"], ascending=[True, False, True, True], kind="stable").itertuples(index=False)
    groups = []
    for gid, members in groupby(rows, key=lambda n: n.group_id):
        g = list(members)
        size = int(g[0].size) if hasattr(g[0], "size") else len(g)  # of the group at the start, where nodes have been barred since
        groups.append((-size, -sum(n.sim for n in g) / len(g), min(min(n.r1, n.r2) for n in g), gid, g))
    parent: dict = {}
    years: dict = {}
    used: set = set()
    out = []
    for size, *_, gid, g in sorted(groups, key=lambda x: x[:4]):
        fit = []
        within: set = set()
        for n in g:
            if n.link in one_to_one_types and (n.r1 in used or n.r2 in used or (strict and (n.r1 in within or n.r2 in within))):
                continue
            if year_gap is not None:
                known = set().union(*(years.get(_clusters(parent, r), set()) if r in parent else set() for r in (n.r1, n.r2)), {y for y in (n.year1, n.year2) if y and y == y})
                if known and max(known) - min(known) > year_gap:
                    continue
            fit.append(n)
            if n.link in one_to_one_types:
                within |= {n.r1, n.r2}
        if size == -1:
            keep = fit if singles_t is not None and fit and fit[0].sim >= singles_t else []
        else:
            keep, total = [], 0.0
            for k, n in enumerate(fit, 1):
                total += n.sim
                if total / k >= merge_t:
                    keep = fit[:k]
            keep = keep if len(keep) >= 2 else []
        for n in keep:
            for r, y in ((n.r1, n.year1), (n.r2, n.year2)):
                if r not in parent:
                    parent[r] = r
                    years[r] = {y} if y and y == y else set()
            a, b = sorted((_clusters(parent, n.r1), _clusters(parent, n.r2)))
            if a != b:
                parent[b] = a
                years[a] = years[a] | years.pop(b)
            if n.link in one_to_one_types:
                used |= {n.r1, n.r2}
            out.append((gid, n.r1, n.r2, n.link, n.sim))
    return pd.DataFrame([(*o, _clusters(parent, o[1])) for o in out], columns=["group_id", "r1", "r2", "link", "sim", "entity"])


def greedy_groups(nodes: DataFrame, merge_t: float, singles_t: float | None = None, one_to_one_types: tuple[str, ...] = (), year_gap: int | None = None, strict: bool = True, task_rows: int = 50_000) -> DataFrame:
    """(group_id, r1, r2, link, sim, entity) of the node pairs that the greedy linker merges.

    nodes: (group_id, r1, r2, link, sim, year1, year2), ids long.  Groups conflict if they share a record; the components of that relation are
    independent, and each is linked by the plain loop in one task, which gives exactly the sequential result.  Components of more than task_rows
    nodes go through rounds of groups that come before all they share a record with, which gives the same result without a bound on a component; with
    year_gap, where groups also meet through entities, they are refused.  Without year_gap, groups of one node, which come last, are taken by free_singles().
    """
    nodes = stash(nodes.select("group_id", "r1", "r2", "link", "sim", F.col("year1").cast("long").alias("year1"), F.col("year2").cast("long").alias("year2")), "nodes")
    if year_gap is None:
        more = nodes.groupBy("group_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("group_id")
        grouped = nodes.join(more, "group_id", "left_semi")
        if singles_t is None:
            nodes = stash(grouped, "grouped")
        else:
            done = stash(greedy_groups(grouped, merge_t, None, one_to_one_types, None, strict, task_rows), "done")
            alone = stash(free_singles(nodes.where(F.col("sim") >= singles_t).join(more, "group_id", "left_anti"), done, one_to_one_types), "alone")
            if nodes.where(~F.col("link").isin(*one_to_one_types)).isEmpty():  # so no record of these is in another merge
                return done.unionByName(alone.withColumn("entity", F.least("r1", "r2")))
            merged = stash(done.drop("entity").unionByName(alone), "merged")
            return merged.join(membership(merged).withColumnRenamed("record", "r1"), "r1").select(*alone.columns, "entity")
    if nodes.isEmpty():
        return nodes.select("group_id", "r1", "r2", "link", "sim", F.col("r1").alias("entity"))
    parts = components(nodes, "r1", "r2")
    marked = nodes.join(parts.withColumnRenamed("v", "r1"), "r1")
    # one group may span parts: its parts belong together
    span = marked.groupBy("group_id").agg(F.min("component").alias("g_part"))
    joined = marked.select("group_id", "component").distinct().join(span, "group_id").select(F.col("component").alias("src"), F.col("g_part").alias("dst"))
    top = components(joined).select(F.col("component").alias("part"), F.col("v").alias("component"))
    marked = stash(marked.join(top, "component").drop("component"), "marked")
    types = set(one_to_one_types)
    sizes = stash(marked.groupBy("part").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > task_rows).select("part")
    if large.isEmpty():
        return _linked(marked, merge_t, singles_t, types, year_gap, strict, task_rows)
    if year_gap is not None:
        raise ValueError("a component of conflicting groups is larger than task_rows; with year_gap it has to fit into a task")
    whole = _linked(marked.join(large, "part", "left_anti"), merge_t, singles_t, types, None, strict, task_rows).drop("entity")
    rounds = _in_rounds(marked.join(large, "part", "left_semi"), merge_t, singles_t, types, strict, task_rows)
    merged = stash(whole.unionByName(rounds), "merged")
    return merged.join(membership(merged).withColumnRenamed("record", "r1"), "r1").select(*whole.columns, "entity")


def free_singles(alone: DataFrame, merged: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(group_id, r1, r2, link, sim) of the single nodes that the greedy linker takes after the groups: by score, then least record, then group.

    The records in use are all that has to be known, so the nodes are sorted and go by in one task, however many conflict: in rounds of nodes that precede
    all others of their records, publications of one title and year would come one a round.
    """
    alone = alone.select("group_id", "r1", "r2", "link", "sim")
    if not types:
        return alone
    barred = merged.where(F.col("link").isin(*types)).select(F.explode(F.array("r1", "r2")).alias("r")).distinct()
    once = alone.where(F.col("link").isin(*types))
    once = once.join(barred.withColumnRenamed("r", "r1"), "r1", "left_anti").join(barred.withColumnRenamed("r", "r2"), "r2", "left_anti")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set[int] = set()
        for x in batches:
            kept = []
            for i, (a, b) in enumerate(zip(x.column("r1").to_pylist(), x.column("r2").to_pylist(), strict=True)):
                if a not in used and b not in used:
                    used |= {a, b}
                    kept.append(i)
            yield x.take(pa.array(kept, pa.int64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alone.schema)
    taken = once.select(*alone.columns).repartition(1).sortWithinPartitions(F.desc("sim"), F.least("r1", "r2"), "group_id").mapInArrow(take, kinds)
    return taken.unionByName(alone.where(~F.col("link").isin(*types)))


def _linked(marked: DataFrame, merge_t: float, singles_t: float | None, types: set[str], year_gap: int | None, strict: bool, task_rows: int) -> DataFrame:
    """link_component on parts that are independent of each other. Many small ones share a task: a call per part would cost more than its work."""
    schema = f"group_id {marked.schema['group_id'].dataType.simpleString()}, r1 long, r2 long, link string, sim double, entity long"
    buckets = max(8, marked.count() // task_rows)
    return marked.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets))).groupBy("bucket").applyInPandas(lambda pdf: link_component(pdf, merge_t, singles_t, types, year_gap, strict), schema)


def _in_rounds(nodes: DataFrame, merge_t: float, singles_t: float | None, types: set[str], strict: bool, task_rows: int) -> DataFrame:
    """(group_id, r1, r2, link, sim) merged in rounds: a group is due once it precedes every group left with which it shares a record."""
    order = nodes.groupBy("group_id").agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.min(F.least("r1", "r2")).alias("first"))
    order = order.select("group_id", F.struct((-F.col("n")).alias("n"), (-F.col("mean")).alias("mean"), "first", F.col("group_id").alias("g")).alias("place"))
    rest = stash(nodes.drop("part").join(order.withColumn("size", -F.col("place.n")), "group_id"), "rest")
    merged = None
    while not rest.isEmpty():
        ends = rest.select("group_id", "place", F.explode(F.array("r1", "r2")).alias("r")).distinct()
        waits = ends.join(ends.groupBy("r").agg(F.min("place").alias("least")), "r").where("place != least").select("group_id").distinct()
        due = stash(rest.join(waits, "group_id", "left_anti").withColumn("part", F.col("group_id")), "due")
        # Of a group whose other nodes were barred, what is left still counts as a group: the size that bars single pairs is that of the start.
        done = stash(_linked(due.drop("place"), merge_t, singles_t, types, None, strict, task_rows).drop("entity"), "done")
        merged = done if merged is None else merged.unionByName(done)
        used = done.where(F.col("link").isin(*types)).select(F.explode(F.array("r1", "r2")).alias("r")).distinct()
        left = rest.join(due.select("group_id").distinct(), "group_id", "left_anti")
        barred = F.col("link").isin(*types) & (F.col("u1").isNotNull() | F.col("u2").isNotNull())
        left = left.join(used.select(F.col("r").alias("r1"), F.lit(True).alias("u1")), "r1", "left").join(used.select(F.col("r").alias("r2"), F.lit(True).alias("u2")), "r2", "left").where(~barred).drop("u1", "u2")
        old, rest = rest, stash(left.select(*rest.columns), "rest")
        drop(old)
    return merged if merged is not None else nodes.select("group_id", "r1", "r2", "link", "sim")


def bootstrap_groups(nodes: DataFrame, bootstrap_t: float, spread: float = 0.2) -> DataFrame:
    """nodes of the groups that are sure enough to be merged first: two nodes at least, their mean at least bootstrap_t and none more than spread below it."""
    sure = nodes.groupBy("group_id").agg(F.count("*").alias("_n"), F.avg("sim").alias("_mean"), F.min("sim").alias("_least"))
    sure = sure.where((F.col("_n") >= 2) & (F.col("_mean") >= bootstrap_t) & (F.col("_least") >= bootstrap_t - spread)).select("group_id")
    return nodes.join(sure, "group_id", "left_semi")


def without_used(nodes: DataFrame, merged: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """nodes whose groups hold no record of the one-to-one types that has been merged already."""
    ends = lambda df: df.where(F.col("link").isin(*types))
    used = ends(merged).select(F.explode(F.array("r1", "r2")).alias("r")).distinct()
    touched = ends(nodes).select("group_id", F.explode(F.array("r1", "r2")).alias("r")).join(used, "r", "left_semi").select("group_id").distinct()
    return nodes.join(touched, "group_id", "left_anti")


def membership(merged: DataFrame) -> DataFrame:
    """(record, entity) of the merged pairs, the entity being the least record linked to it."""
    return components(merged, "r1", "r2").select(F.col("v").alias("record"), F.col("component").alias("entity"))


def dependency_linkage(nodes: DataFrame, edges: DataFrame, merge_t: float) -> DataFrame:
    """(node, score, merged): the dependency-graph baseline. A node merges once 0.9 of its attribute score plus 0.1 for each merged strong
    and 0.05 for each merged weak neighbour reaches merge_t; only nodes next to new merges are looked at again, until there are none.

    nodes: (node, sim_attr); edges: (src, dst, strong boolean), src supporting dst.  Scores only rise, so the result does not depend on the order.
    """
    state = stash(nodes.select("node", "sim_attr", (F.col("sim_attr") * 0.9).alias("score"), (F.col("sim_attr") * 0.9 >= merge_t).alias("merged")), "state")
    fresh = stash(state.where("merged").select(F.col("node").alias("src")), "fresh")
    while not fresh.isEmpty():
        gain = edges.join(fresh, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.when(F.col("strong"), 0.1).otherwise(0.05)).alias("gain"))
        moved = state.join(gain, "node", "left").select("node", "sim_attr", (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"), F.col("merged").alias("was"))
        old, state = state, stash(moved.withColumn("merged", F.col("was") | (F.col("score") >= merge_t)), "state")
        drop(old)
        old, fresh = fresh, stash(state.where("merged and not was").select(F.col("node").alias("src")), "fresh")
        drop(old)
    return state.select("node", "score", "merged")


def value_propagation(members: DataFrame, values: DataFrame, pairs: DataFrame, atomic: DataFrame) -> DataFrame:
    """(r1, r2, attr, sim): for each pair the best alike pair of values that the entities of its two records hold.

    members: (record, entity), values: (record, attr, v).  A record without entity stands for itself.
    """
    def held(r: str, v: str) -> DataFrame:
        own = pairs.select(F.col(r).alias("record")).distinct().join(members, "record", "left").select(F.col("record").alias(r), F.coalesce("entity", F.col("record")).alias("e"))
        of = values.join(members, "record", "left").select(F.coalesce("entity", F.col("record")).alias("e"), "attr", F.col("v").alias(v)).distinct()
        return own.join(of, "e").select(r, "attr", v)

    both = atomic.select("attr", "v1", "v2", "sim").unionByName(atomic.where("v1 != v2").select("attr", F.col("v2").alias("v1"), F.col("v1").alias("v2"), "sim"))
    found = pairs.select("r1", "r2").join(held("r1", "v1"), "r1").join(held("r2", "v2"), ["r2", "attr"]).join(both, ["attr", "v1", "v2"])
    return found.groupBy("r1", "r2", "attr").agg(F.max("sim").alias("sim"))


# --- refinement --------------------------------------------------------------------------------------------------


def bridges_of(edges: list[tuple]) -> set[tuple]:
    """Edges (a, b), a < b, of a small graph whose removal parts it: low points of a depth-first search, without recursion."""
    around: dict = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    depth, low, found = {}, {}, set()
    for root in around:
        if root in depth:
            continue
        depth[root] = low[root] = 0
        stack = [(root, None, iter(sorted(around[root])))]
        while stack:
            v, up, rest = stack[-1]
            for w in rest:
                if w == up:
                    continue
                if w in depth:
                    low[v] = min(low[v], depth[w])
                else:
                    depth[w] = low[w] = depth[v] + 1
                    stack.append((w, v, iter(sorted(around[w]))))
                    break
            else:
                stack.pop()
                if up is not None:
                    low[up] = min(low[up], low[v])
                    if low[v] > depth[up]:
                        found.add((min(v, up), max(v, up)))
    return found


def without_bridges(edges: DataFrame, least_records: int) -> DataFrame:
    """(entity, r1, r2) without the bridges of entities of at least least_records records.

    Each entity is a small graph by design (it names one person); the search runs per entity.
    """
    ends = edges.select("entity", F.explode(F.array("r1", "r2")).alias("r"))
    sizes = ends.groupBy("entity").agg(F.count_distinct("r").alias("n"))
    sized = edges.select("entity", "r1", "r2").join(sizes, "entity")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [(min(a, b), max(a, b)) for a, b in zip(pdf["r1"], pdf["r2"], strict=True)]
        gone = bridges_of(pairs)
        return pdf.loc[[p not in gone for p in pairs], ["entity", "r1", "r2"]]

    kind = edges.schema["r1"].dataType.simpleString()
    large = sized.where(F.col("n") >= least_records).groupBy("entity").applyInPandas(cut, f"entity {edges.schema['entity'].dataType.simpleString()}, r1 {kind}, r2 {kind}")
    return sized.where(F.col("n") < least_records).select("entity", "r1", "r2").unionByName(large)


def sparse_members(edges: DataFrame, least: int = 4, most_density: float = 0.3) -> DataFrame:
    """(entity, record): of entities of at least `least` records with at most that density, the record of least degree, if only one has it."""
    once = edges.select("entity", F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b")).distinct()
    degree = once.select("entity", F.explode(F.array("a", "b")).alias("record")).groupBy("entity", "record").agg(F.count("*").alias("degree"))
    w = Window.partitionBy("entity")
    marked = degree.withColumn("n", F.count("*").over(w)).withColumn("ends", F.sum("degree").over(w)).withColumn("low", F.min("degree").over(w))
    marked = marked.withColumn("lows", F.sum((F.col("degree") == F.col("low")).cast("int")).over(w))
    density = F.col("ends") / (F.col("n") * (F.col("n") - 1))
    return marked.where((F.col("n") >= least) & (density <= most_density) & (F.col("degree") == F.col("low")) & (F.col("lows") == 1)).select("entity", "record")


def related_pairs(members: DataFrame, relations: DataFrame, nodes: DataFrame, merge_t: float, free: tuple[str, ...] = ("mother", "father")) -> DataFrame:
    """(r1, r2, relation, sim): pairs of relatives of one entity's records that are nodes; mothers and fathers need no score, others merge_t.

    relations: (record, relation, other).  nodes: (r1, r2, sim).
    """
    held = members.join(relations, "record").select("entity", "relation", "other").distinct()
    both = held.withColumnRenamed("other", "r1").join(held.withColumnRenamed("other", "r2"), ["entity", "relation"]).where("r1 < r2")
    canonical = nodes.select(F.least("r1", "r2").alias("r1"), F.greatest("r1", "r2").alias("r2"), "sim")
    return both.join(canonical, ["r1", "r2"]).where(F.col("relation").isin(*free) | (F.col("sim") >= merge_t)).select("r1", "r2", "relation", "sim").distinct()


def state_counts(nodes: DataFrame, column: str = "state") -> DataFrame:
    return nodes.groupBy(column).agg(F.count("*").alias("n"))


def relation_edges(pairs: DataFrame, strength: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(src, dst, strong) between the nodes of one household or certificate pair.

    pairs: (node, block, role1): nodes of the same block support each other; a child's node supports its father's strongly, all other ways are weak.
    """
    other = pairs.select(F.col("node").alias("dst"), "block", F.col("role").alias("to_role"))
    both = pairs.select(F.col("node").alias("src"), "block", F.col("role").alias("from_role")).join(other, "block").where("src != dst")
    strong = (F.col("from_role") == "C") & (F.col("to_role") == "F") if strength is None else strength(F.col("from_role"), F.col("to_role"))
    return both.select("src", "dst", strong.alias("strong"))
