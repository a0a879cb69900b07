"""Consolidating pairwise matches into groups.

Rake-and-compress over the match graph: vertices of degree one are stripped, maximal
chains of degree-two vertices are replaced by one edge between their ends (found by
list ranking: pointer doubling over directed edges), and this repeats while it shrinks the
graph.  What is left, the reduced core, is solved by alternating large-star and
small-star rewrites; the removed vertices then take over their parent's label in
reverse order.  Every step is a keyed join or aggregate, so no component ever has
to fit into one task, and every round's state is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin.session import drop, read, stash


def _neighbours(edges: DataFrame) -> DataFrame:
    """One row per vertex: degree and its least and greatest neighbour (for degree two these are both)."""
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a")))
    return arcs.groupBy("u").agg(F.count("*").alias("deg"), F.min("v").alias("n1"), F.max("v").alias("n2"))


def strip_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed: child, parent; the edges left). Of an edge between two leaves the smaller end stays."""
    nb = stash(_neighbours(edges), "degrees")
    leaves = nb.where("deg = 1").select(F.col("u").alias("child"), F.col("n1").alias("parent"))
    inner = nb.where("deg = 1").select(F.col("u").alias("parent"), F.col("n1").alias("other"))
    removed = (
        leaves.join(inner, "parent", "left")
        .where("other is null or child > parent")
        .select("child", "parent")
    )
    removed = stash(removed, "leaves")
    gone = removed.select(F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b"))
    return removed, edges.join(gone, ["a", "b"], "left_anti")


def compress_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed: child, parent; the edges left) with every maximal chain of degree-two vertices replaced by one edge.

    Each directed edge u->v into a chain vertex v points to the next one, v->w; doubling these
    pointers finds the far end in log(length) rounds.  A pure cycle has no end: its edges go on until a round brings no news, when they
    have seen the whole cycle, and take its least vertex.
    """
    nb = stash(_neighbours(edges), "degrees")
    chain = nb.where("deg = 2")
    if chain.isEmpty():
        return nb.sparkSession.createDataFrame([], "child long, parent long"), edges
    into = chain.select(F.col("n1").alias("s"), F.col("u").alias("t"), F.col("n2").alias("w")).unionAll(
        chain.select(F.col("n2"), F.col("u"), F.col("n1"))
    )
    ends = chain.select(F.col("u").alias("w"), F.lit(True).alias("open"))
    state = into.join(ends, "w", "left").select(
        "s", "t", F.col("t").alias("cs"), F.col("w").alias("ct"), F.coalesce("open", F.lit(False)).alias("open"), F.col("t").alias("least")
    )
    state = stash(state, "chain")
    going = state.where("open").count()
    while going:
        nxt = state.select(
            F.col("s").alias("cs"), F.col("t").alias("ct"), F.col("cs").alias("xs"), F.col("ct").alias("xt"), F.col("open").alias("xopen"), F.col("least").alias("xleast")
        )
        moved = state.where("open").join(nxt, ["cs", "ct"]).select(
            "s", "t", F.col("xs").alias("cs"), F.col("xt").alias("ct"), F.col("xopen").alias("open"), F.least("least", "xleast").alias("least"), (~F.col("xopen") | (F.col("xleast") < F.col("least"))).alias("news")
        )
        old, state = state, stash(state.where("not open").withColumn("news", F.lit(False)).select(*moved.columns).unionByName(moved), "chain")
        drop(old)
        # Where edges are left to go, some are between one and two steps of this round from an end, or from the least vertex of their cycle.
        going = state.where("news").count() and state.where("open").count()
    per_vertex = state.groupBy(F.col("t").alias("child")).agg(
        F.min(F.when(~F.col("open"), F.col("ct"))).alias("e1"), F.max(F.when(~F.col("open"), F.col("ct"))).alias("e2"), F.min("least").alias("least")
    )
    per_vertex = stash(per_vertex, "chain")
    removed = per_vertex.select("child", F.coalesce("e1", "least").alias("parent")).where("child != parent")
    bridges = per_vertex.where("e1 < e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    inside = chain.select(F.col("u").alias("a"))
    kept = edges.join(inside, "a", "left_anti").join(inside.select(F.col("a").alias("b")), "b", "left_anti")
    return removed, kept.select("a", "b").unionByName(bridges).distinct()


def star_contract(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the core: alternating large-star and small-star until nothing changes."""

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            arcs = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        else:
            arcs = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = arcs.join(least, "u")
        hung = hung.select("v", "m") if small else hung.where("v > u").select("v", "m")
        out = hung.unionAll(least.select("u", "m")) if small else hung
        return out.where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stash(edges, "core")
    before = mark(edges)
    while True:
        large = stash(star(edges, False), "core")
        old, edges = edges, stash(star(large, True), "core")
        drop(large)
        drop(old)
        after = mark(edges)
        if after == before:
            return edges.select(F.col("b").alias("v"), F.col("a").alias("label"))
        before = after


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", shrink: float = 0.7) -> DataFrame:
    """(v long, label long): every vertex of pairs with one label per connected component.

    pairs: two long columns a and b; other columns are ignored, whatever their names.  Null ids are
    dropped with their pair; repeated and mirrored pairs count once; a pair of a vertex with itself makes
    that vertex a group of its own; an empty table gives an empty result.  The label is some vertex of the group.
    shrink: rake-and-compress goes on while a round leaves less than this share of the edges.
    """
    spark = pairs.sparkSession
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    base = stash(pairs.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "pairs")  # read once
    edges = base.where("a < b")
    n, removed = edges.count(), []
    vertices = base.select(F.col("a").alias("v")).unionAll(base.select("b")).distinct()
    while n:
        off, edges = strip_leaves(edges)
        removed.append(off)
        edges = stash(edges, "edges")
        off, edges = compress_chains(edges)
        removed.append(stash(off, "chains"))
        edges = stash(edges, "edges")
        left = edges.count()
        if left > shrink * n:
            break
        n = left
    labels = star_contract(edges) if not edges.isEmpty() else spark.createDataFrame([], "v long, label long")
    for off in reversed(removed):
        known = labels.select(F.col("v").alias("parent"), "label")
        back = off.join(known, "parent", "left").select(F.col("child").alias("v"), F.coalesce("label", "parent").alias("label"))
        labels = stash(labels.unionByName(back), "labels")
    return vertices.join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def match_groups(decisions: DataFrame) -> DataFrame:
    """(side, record_id, group_id) of every record in a pair labelled 1; group_id is the group's smallest left id.

    A left and a right id of the same number are different vertices: ids are folded as 2 * id for
    the left side and 2 * id + 1 for the right one.  Pairs with a null id or without any label-1 row are left out.
    """
    hits = decisions.where("label = 1 and ltable_id is not null and rtable_id is not null")
    pairs = hits.select((F.col("ltable_id") * 2).alias("a"), (F.col("rtable_id") * 2 + 1).alias("b"))
    groups = connected_groups(pairs).withColumn("left", F.pmod("v", F.lit(2)) == 0)
    groups = groups.withColumn("record_id", F.expr("(v - pmod(v, 2)) div 2"))
    least = groups.where("left").groupBy("label").agg(F.min("record_id").alias("group_id"))
    return groups.join(least, "label").select(F.when(F.col("left"), "l").otherwise("r").alias("side"), "record_id", "group_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups(read(spark, sf_dir, "valid").select("ltable_id", "rtable_id", "label"))


SQL = {
    "p1_found": """
        WITH RECURSIVE e AS (
            SELECT DISTINCT 2 * ltable_id AS u, 2 * rtable_id + 1 AS v FROM valid
            WHERE label = 1 AND ltable_id IS NOT NULL AND rtable_id IS NOT NULL),
        arcs AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        reach(src, v) AS (
            SELECT DISTINCT u, u FROM arcs WHERE u % 2 = 0
            UNION
            SELECT r.src, arcs.v FROM reach r JOIN arcs ON arcs.u = r.v)
        SELECT CASE WHEN v % 2 = 0 THEN 'l' ELSE 'r' END AS side,
               CAST(v // 2 AS BIGINT) AS record_id, CAST(min(src) // 2 AS BIGINT) AS group_id
        FROM reach GROUP BY v
    """
}
QUERIES = {"p1_found": p1_found}
