"""Candidate pairs of the civil pipeline: roles that may be linked, their gates, and the relatives' pairs that come with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergekin.predicates import CIVIL_LINKS, civil_link_valid, sexes_agree

#: For two roles, whether the link predicate gates the pair, and the relatives' pairs that come along.
#: 'spouse' pairs the spouses, 'parents' the mothers and the fathers.
CANDIDATES: dict[tuple[str, str], tuple[bool, tuple[str, ...]]] = {
    ("Bb", "Bp"): (True, ()), ("Bb", "Mbp"): (True, ()), ("Bb", "Mgp"): (True, ()), ("Bb", "Ds"): (True, ()), ("Bb", "Dp"): (True, ()),
    ("Bb", "Mm"): (True, ("parents",)), ("Bb", "Dd"): (True, ("parents",)),
    ("Bp", "Bp"): (True, ("spouse",)), ("Bp", "Mm"): (True, ("spouse",)), ("Bp", "Dd"): (True, ("spouse",)), ("Bp", "Ds"): (False, ("spouse",)),
    ("Mm", "Mm"): (True, ("parents",)), ("Mm", "Mbp"): (True, ("spouse",)), ("Mm", "Mgp"): (True, ("spouse",)), ("Mm", "Dd"): (True, ("parents", "spouse")),
    ("Mm", "Ds"): (False, ("spouse",)), ("Mm", "Dp"): (False, ("spouse",)),
    ("Mbp", "Dd"): (False, ("spouse",)), ("Mbp", "Ds"): (False, ("spouse",)), ("Mgp", "Dd"): (False, ("spouse",)), ("Mgp", "Ds"): (False, ("spouse",)),
    ("Dd", "Ds"): (False, ("spouse",)), ("Dd", "Dp"): (False, ("spouse",)), ("Ds", "Dp"): (False, ("spouse",)), ("Dp", "Dp"): (False, ("spouse",)), ("Ds", "Ds"): (False, ()),
}
#: Role pairs whose parents are paired even where the two are not the same person but may be siblings.
SIBLINGS = [("Bb", "Mm"), ("Bb", "Dd"), ("Mm", "Dd"), ("Mm", "Mm")]


def link_of(role1: Column, role2: Column) -> Column:
    """The listed link of two roles, in either order; null if there is none."""
    forward, back = F.concat_ws("-", role1, role2), F.concat_ws("-", role2, role1)
    return F.when(forward.isin(CIVIL_LINKS), forward).when(back.isin(CIVIL_LINKS), back)


def civil_candidates(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """(r1, r2, link, origin) of candidate nodes from accepted record pairs (r1, r2).

    people: id, role, sex, event_date, birth_year, marriage_year, marital_status, mother, father, spouse.  A pair is turned so that its roles
    stand as listed, passes its gate, and brings its relatives' pairs; where it fails the gate and both mothers are known, siblings may have
    been found, and only the parents' pairs come.  A node that arises several ways comes once, as itself before as a relative.
    """
    p = people.select("id", F.struct("id", "role", "sex", "event_date", "birth_year", "marriage_year", "marital_status", "mother", "father", "spouse").alias("p"))
    both = pairs.join(p.select(F.col("id").alias("r1"), F.col("p").alias("x")), "r1").join(p.select(F.col("id").alias("r2"), F.col("p").alias("y")), "r2")
    listed = F.array(*[F.lit(f"{a}-{b}") for a, b in CANDIDATES])
    forward, back = F.concat_ws("-", "x.role", "y.role"), F.concat_ws("-", "y.role", "x.role")
    turn = ~F.array_contains(listed, forward) & F.array_contains(listed, back)
    both = both.select(F.when(turn, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(turn, F.col("x")).otherwise(F.col("y")).alias("b"), F.when(turn, back).otherwise(forward).alias("link"))
    both = both.where(F.array_contains(listed, F.col("link")))
    gated = F.col("link").isin([f"{a}-{b}" for (a, b), (gate, _) in CANDIDATES.items() if gate])
    same_sex = sexes_agree(F.col("a.sex"), F.col("b.sex"))
    unmarried = (F.col("link") == "Mm-Dd") & F.coalesce(F.col("b.marital_status") == "s", F.lit(False))
    passed = same_sex & ~unmarried & (~gated | civil_link_valid(F.col("link"), "a", "b"))
    both = both.withColumn("ok", passed)

    with_spouse = [f"{a}-{b}" for (a, b), (_, e) in CANDIDATES.items() if "spouse" in e]
    with_parents = [f"{a}-{b}" for (a, b), (_, e) in CANDIDATES.items() if "parents" in e]
    siblings = F.col("link").isin([f"{a}-{b}" for a, b in SIBLINGS]) & F.col("a.mother").isNotNull() & F.col("b.mother").isNotNull()
    parents = (F.col("ok") & F.col("link").isin(with_parents)) | (~F.col("ok") & siblings)
    node = lambda cond, a, b, origin: F.when(cond, F.struct(a.alias("r1"), b.alias("r2"), F.lit(origin).alias("origin")))
    made = F.array(
        node(F.col("ok"), F.col("a.id"), F.col("b.id"), "self"), node(F.col("ok") & F.col("link").isin(with_spouse), F.col("a.spouse"), F.col("b.spouse"), "spouse"),
        node(parents, F.col("a.mother"), F.col("b.mother"), "mother"), node(parents, F.col("a.father"), F.col("b.father"), "father"),
    )
    nodes = both.select(F.explode(F.array_compact(made)).alias("n")).select("n.*").where("r1 is not null and r2 is not null and r1 != r2")
    first = F.when(F.col("origin") == "self", 0).otherwise(1)
    nodes = nodes.select(F.least("r1", "r2").alias("r1"), F.greatest("r1", "r2").alias("r2"), "origin", first.alias("k")).groupBy("r1", "r2").agg(F.min_by("origin", "k").alias("origin"))
    roles = people.select("id", "role")
    named = nodes.join(roles.select(F.col("id").alias("r1"), F.col("role").alias("role1")), "r1").join(roles.select(F.col("id").alias("r2"), F.col("role").alias("role2")), "r2")
    return named.select("r1", "r2", link_of(F.col("role1"), F.col("role2")).alias("link"), "origin").where("link is not null")


def certificate_edges(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, dst, strength, relation) between nodes whose records are relatives on both certificates: child to parent strong, other ways weak.

    nodes: (node, r1, r2); relations: (record, relation, other).
    """
    rel1, rel2 = relations.select(F.col("record").alias("r1"), "relation", F.col("other").alias("o1")), relations.select(F.col("record").alias("r2"), "relation", F.col("other").alias("o2"))
    target = nodes.select(F.col("node").alias("dst"), F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b"))
    near = nodes.join(rel1, "r1").join(rel2, ["r2", "relation"]).select(F.col("node").alias("src"), "relation", F.least("o1", "o2").alias("a"), F.greatest("o1", "o2").alias("b"))
    strength = F.when(F.col("relation").isin("mother", "father"), "BS").otherwise("BW")
    return near.join(target, ["a", "b"]).where("src != dst").select("src", "dst", strength.alias("strength"), "relation").distinct()


def entities_of(members: DataFrame, people: DataFrame) -> DataFrame:
    """Aggregates of each entity that its constraints look at: sexes, event years, birth years, certificates by role."""
    held = members.join(people, members["record"] == people["id"])
    return held.groupBy("entity").agg(
        F.collect_set("sex").alias("sexes"), F.min("event_year").alias("first_year"), F.max("event_year").alias("last_year"), F.min("birth_year").alias("least_birth"), F.max("birth_year").alias("most_birth"),
        F.min("marriage_year").alias("least_marriage"), F.max("marriage_year").alias("most_marriage"), F.count(F.when(F.col("role") == "Bb", 1)).alias("births"), F.count(F.when(F.col("role") == "Dd", 1)).alias("deaths"),
        F.max(F.when(F.col("role") == "Dd", F.col("event_year"))).alias("death_year"), F.max(F.when(F.col("role") == "Bb", F.col("event_year"))).alias("birth_event"), F.collect_set(F.struct("cert_id", "role")).alias("certs"),
    )


def entities_compatible(a: str, b: str) -> Column:
    """Whether two entity aggregates (struct columns) may be one person.

    Sexes agree, at most one birth and one death, no certificate names both in different roles, no event before the birth or more than a year after the
    death, and birth and marriage years all close (least and greatest instead of all pairs).
    """
    x, y = lambda f: F.col(f"{a}.{f}"), lambda f: F.col(f"{b}.{f}")
    yes = lambda c: F.coalesce(c, F.lit(True))
    spread = lambda lo, hi: F.greatest(x(hi), y(hi)) - F.least(x(lo), y(lo))
    certs = lambda f: F.transform(f("certs"), lambda c: c["cert_id"])
    birth, death = F.coalesce(x("birth_event"), y("birth_event")), F.coalesce(x("death_year"), y("death_year"))
    return (
        (F.size(F.array_union(x("sexes"), y("sexes"))) <= 1) & (x("births") + y("births") <= 1) & (x("deaths") + y("deaths") <= 1) & ~F.arrays_overlap(certs(x), certs(y))
        & yes(F.least(x("first_year"), y("first_year")) >= birth) & yes(F.greatest(x("last_year"), y("last_year")) <= death + 1)
        & yes(spread("least_birth", "most_birth") <= 2) & yes(spread("least_marriage", "most_marriage") <= 20)
    )


def unused_singletons(nodes: DataFrame, used: DataFrame, singleton_links: list[str]) -> DataFrame:
    """nodes without those of a singleton link that one of their records has used already. used: (record, link)."""
    once = nodes.where(F.col("link").isin(singleton_links))
    taken = used.select("record", "link").distinct()
    once = once.join(taken.withColumnRenamed("record", "r1"), ["r1", "link"], "left_anti").join(taken.withColumnRenamed("record", "r2"), ["r2", "link"], "left_anti")
    return nodes.where(~F.col("link").isin(singleton_links)).unionByName(once)
