"""The bibliographic pipeline under its own rules: alike values in phonetic blocks, groups, bootstrap, linking, evaluation.

Records are those of the sources (source and origin number); the values of all deliveries of one stand for it, so a pair has the best evidence
that any two deliveries give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin import standardise as S
from mergekin.config import ATOMIC_T, BOOTSTRAP_T, MERGE_T, rules
from mergekin.functions.columns import abs_difference
from mergekin.operators import evidence as E
from mergekin.operators import graphs as G
from mergekin.operators.evaluate import quality
from mergekin.session import read, stash

RULES = rules(ATOMIC_T)
ONE_TO_ONE = ("P-P", "A-A")
#: So many records of one title are joined in a task with a part of what meets them.
ONE_PART = 256


@dataclass
class Bibliography:
    """Publications (rec, source, id, pub_name, venue, year) and authors (rec, author, source, fname, sname), one row a delivery."""

    pubs: DataFrame
    authors: DataFrame

    def side(self, source: str) -> tuple[DataFrame, DataFrame]:
        return self.pubs.where(F.col("source") == source), self.authors.where(F.col("source") == source)


def load(spark: SparkSession, d: str) -> Bibliography:
    pubs = read(spark, d, "publication_dict").where("source in ('A', 'B') and origin_id is not null").dropDuplicates(["id"])
    pubs = pubs.select("id", "source", (F.col("origin_id") * 2 + (F.col("source") == "B").cast("long")).alias("rec"), S.standard_string("pub_name").alias("pub_name"), S.standard_string("venue").alias("venue"), F.when(F.col("year") > 0, F.col("year")).alias("year"))
    pubs = stash(pubs, "pubs")
    people = read(spark, d, "people_dict").dropDuplicates(["id"]).select(F.col("pub_id").alias("id"), "author_no", S.standard_string("fname").alias("fname"), S.standard_string("sname").alias("sname"))
    people = people.join(pubs.select("id", "rec", "source"), "id").where("sname is not null")
    return Bibliography(pubs, stash(people.select("rec", "source", F.xxhash64("rec", "author_no").alias("author"), "fname", "sname"), "authors"))


def phrases(b: Bibliography) -> DataFrame:
    """Alike titles and venues of publications, across the sources."""
    (pa_, _), (pb, _) = b.side("A"), b.side("B")
    r = RULES["def_pubs"]
    return E.alike_phrases(pa_, pb, "pub_name", "pub_name", r.must.min_sim).unionByName(E.alike_phrases(pa_, pb, "venue", "venue", r.extra.min_sim))


def atomic(b: Bibliography) -> DataFrame:
    """Alike titles, years and venues of publications and names of authors, across the sources."""
    (pa_, aa), (pb, ab) = b.side("A"), b.side("B")
    r = RULES["def_pubs"]
    found = phrases(b).unionByName(E.alike_values(pa_, pb, "year", "year", r.core.min_sim))
    for c in ("sname", "fname"):
        found = found.unionByName(E.alike_values(aa, ab, c, c, RULES["def_authors"].core.min_sim))
    return stash(found, "atomic")


def accepted_publications(b: Bibliography, values: DataFrame) -> DataFrame:
    """(r1, r2, pub_name, year, venue, sim) of all publication pairs that the rule accepts: titles alike, whatever the years, venues and authors.

    values: the alike titles and venues.  The likenesses are those of the sets of titles and of venues that records hold over their deliveries, so a title of
    very many records is compared once.  Each pair of records then arises once, with all that scores it at hand, from one join that nothing has to
    follow; a title of many records in B is spread over several tasks.
    """
    r, spark = RULES["def_pubs"], b.pubs.sparkSession
    each = b.pubs.groupBy("source", "rec").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("pub_name", "venue", "year")]).where(F.size("pub_name") > 0)
    each = stash(each.withColumns({"titles": F.xxhash64("pub_name"), "venues": F.xxhash64("venue")}), "profiles")
    side = lambda source, k: each.where(F.col("source") == source).select(F.col("rec").alias(f"r{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("titles", "venues", "year", "pub_name", "venue")])
    a, z = side("A", 1), side("B", 2)

    def sets(attribute: str, key: str) -> DataFrame:
        held = lambda df, k: df.select(f"{key}{k}", F.explode(f"{attribute}{k}").alias(f"v{k}")).distinct()
        alike = E._both_ways(values.where(F.col("attr") == attribute)).select("v1", "v2", "sim")
        return held(a, 1).join(alike, "v1").join(held(z, 2), "v2").groupBy(f"{key}1", f"{key}2").agg(F.max("sim").alias("sim"))

    parts = z.groupBy("titles2").agg(F.ceil(F.count("*") / ONE_PART).alias("parts"))
    titles = sets("pub_name", "titles").withColumnRenamed("sim", "pub_name").join(parts, "titles2")
    venues = sets("venue", "venues").groupBy("venues1").agg(F.map_from_entries(F.collect_list(F.struct("venues2", "sim"))).alias("alike_venues"))
    left = a.select("r1", "titles1", "venues1", F.col("year1").cast("array<double>")).join(titles, "titles1").join(venues, "venues1", "left")
    left = left.select("r1", "titles2", "pub_name", "year1", "alike_venues", F.pmod(F.xxhash64("r1"), "parts").alias("part"))
    right = z.join(parts, "titles2").select("r2", "titles2", "venues2", F.col("year2").cast("array<double>"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(tasks, "titles2", "part").join(right.repartition(tasks, "titles2", "part"), ["titles2", "part"])
    years = F.array_max(F.flatten(F.transform("year1", lambda x: F.transform("year2", lambda y: abs_difference(x, y)))))
    years = F.when((F.size("year1") == 1) & (F.size("year2") == 1), abs_difference(F.col("year1")[0], F.col("year2")[0])).otherwise(years)
    pairs = pairs.select("r1", "r2", "pub_name", years.alias("year"), F.try_element_at("alike_venues", F.col("venues2")).alias("venue"))
    return E.weighted_wide(pairs, r).withColumnRenamed("sim_attr", "sim")


def publication_nodes(b: Bibliography, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (r1, r2, sim), their evidence) of the accepted publication pairs that linking can merge.

    Those are the pairs where the titles are alike and the years or an author's surname are, too, each in any two deliveries: a pair with neither has no
    author pair and scores 0.8 at most, so it is never merged.  accepted_publications() has all pairs.
    """
    (pa_, aa), (pb, ab) = b.side("A"), b.side("B")
    r = RULES["def_pubs"]
    titles = lambda p, a: p.select("rec", "pub_name").join(a.select("rec", "sname").distinct(), "rec")
    by_year = accepted_publications(b, values).where(F.col("year") >= r.core.min_sim).select("r1", "r2")
    by_author = E.pair_evidence(titles(pa_, aa), titles(pb, ab), values, ["pub_name", "sname"], "rec", drive=["pub_name", "sname"]).select("r1", "r2")
    pairs = stash(by_year.unionByName(by_author).distinct(), "pairs")
    evidence = stash(E.evidence_of(pairs, pa_, pb, values, list(r.category_of()), "rec"), "evidence")
    scored = E.accepted_pairs(evidence, r).select("r1", "r2").join(E.weighted_scores(evidence, r), ["r1", "r2"])
    return stash(scored.select("r1", "r2", F.col("sim_attr").alias("sim")), "pub-nodes"), evidence


def author_nodes(b: Bibliography, values: DataFrame, pubs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(p1, p2, r1, r2, sim): author pairs of accepted publication pairs with alike surnames and alike first names, or an initial that fits."""
    (_, aa), (_, ab) = b.side("A"), b.side("B")
    r = RULES["def_authors"]
    both = E._both_ways(values)
    names = both.where("attr = 'sname'").select(F.col("v1").alias("s1"), F.col("v2").alias("s2"), F.col("sim").alias("s_sim"))
    firsts = both.where("attr = 'fname'").select(F.col("v1").alias("f1"), F.col("v2").alias("f2"), F.col("sim").alias("f_sim"))
    x = pubs.select(F.col("r1").alias("p1"), F.col("r2").alias("p2")).join(aa.select(F.col("rec").alias("p1"), F.col("author").alias("r1"), F.col("sname").alias("s1"), F.col("fname").alias("f1")), "p1")
    x = x.join(names, "s1").join(ab.select(F.col("rec").alias("p2"), F.col("author").alias("r2"), F.col("sname").alias("s2"), F.col("fname").alias("f2")), ["p2", "s2"]).join(firsts, ["f1", "f2"], "left")
    initial = ((F.length("f1") == 1) | (F.length("f2") == 1)) & (F.substring("f1", 1, 1) == F.substring("f2", 1, 1))
    x = x.where(F.col("f_sim").isNotNull() | initial).groupBy("p1", "p2", "r1", "r2").agg(F.max("s_sim").alias("sname"), F.max(F.coalesce("f_sim", F.lit(ATOMIC_T))).alias("fname"))
    of_pub = evidence.where("attr in ('pub_name', 'year')").groupBy(F.col("r1").alias("p1"), F.col("r2").alias("p2")).pivot("attr", ["pub_name", "year"]).agg(F.max("sim"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("sim")) for a in ("sname", "fname", "pub_name", "year")])).alias("x")
    ev = x.join(of_pub, ["p1", "p2"]).select("p1", "p2", "r1", "r2", each).select("p1", "p2", "r1", "r2", "x.attr", "x.sim").where("sim is not null")
    ev = stash(ev, "author-evidence")
    scores = E.weighted_scores(ev, r).select("r1", "r2", F.col("sim_attr").alias("sim"))
    return ev.select("p1", "p2", "r1", "r2").distinct().join(scores, ["r1", "r2"])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, r1, r2, link, sim, year1, year2): each publication pair with its author pairs."""
    b = load(spark, d)
    values = atomic(b)
    pubs, evidence = publication_nodes(b, values)
    authors = author_nodes(b, values, pubs, evidence)
    years = b.pubs.groupBy("rec").agg(F.min("year").cast("long").alias("year"))
    dated = pubs.join(years.select(F.col("rec").alias("r1"), F.col("year").alias("year1")), "r1", "left").join(years.select(F.col("rec").alias("r2"), F.col("year").alias("year2")), "r2", "left")
    none = F.lit(None).cast("long")
    p = dated.select(F.xxhash64("r1", "r2").alias("group_id"), "r1", "r2", F.lit("P-P").alias("link"), "sim", "year1", "year2")
    a = authors.select(F.xxhash64("p1", "p2").alias("group_id"), "r1", "r2", F.lit("A-A").alias("link"), "sim", none.alias("year1"), none.alias("year2"))
    return stash(p.unionByName(a), "bib-nodes")


def sure_groups(found: DataFrame) -> DataFrame:
    """What is merged of the groups that are sure enough to come first."""
    return stash(G.greedy_groups(G.bootstrap_groups(found, BOOTSTRAP_T), BOOTSTRAP_T, None, ONE_TO_ONE), "first")


def resolved(found: DataFrame, propagate: bool = True, relations: bool = True, first: DataFrame | None = None) -> DataFrame:
    """(r1, r2, link, sim, reason) of merged nodes: the sure groups first, then the rest by size and mean, then single pairs.

    Publications and authors are in one pair each, so two authors of a work never become one.  propagate: whether the first merges bar records for the
    later ones (without, the two steps know nothing of each other).  relations: whether nodes stand in groups (without, each stands alone).
    first: sure_groups() of found, where they are known.
    """
    found = found if relations else found.withColumn("group_id", F.xxhash64("r1", "r2", "link"))
    first = first if first is not None and relations else sure_groups(found)
    later = G.without_used(found, first, ONE_TO_ONE) if propagate else found.join(first.select("group_id").distinct(), "group_id", "left_anti")
    second = G.greedy_groups(later, MERGE_T, ATOMIC_T, ONE_TO_ONE)
    tell = lambda df, reason: df.select("r1", "r2", "link", "sim", F.lit(reason).alias("reason"))
    return tell(first, "sure group").unionByName(tell(second, "group"))


# --- queries -------------------------------------------------------------------------------------------------------------


def rule_publication_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Publication pairs of the two sources under the rule for publications: titles at least 0.9 alike by sorted Winkler."""
    b = load(spark, d)
    return accepted_publications(b, stash(phrases(b), "phrases")).select("r1", "r2", F.round("sim", 6).alias("score"))


def resolved_bibliography(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: publications and authors of the two sources merged in groups."""
    return resolved(nodes(spark, d)).select("r1", "r2", "link", F.round("sim", 6).alias("sim"), "reason")


def resolved_by_reason(spark: SparkSession, d: str) -> DataFrame:
    """Merged and unmerged nodes of the pipeline by link and reason, and the same without relations and without propagation."""
    n = nodes(spark, d)
    total = n.groupBy("link").agg(F.count("*").alias("nodes"))
    first = sure_groups(n)
    ways = {"whole": {"first": first}, "no relations": {"relations": False}, "no propagation": {"propagate": False, "first": first}}
    out = [resolved(n, **w).groupBy("link", "reason").agg(F.count("*").alias("merged")).withColumn("way", F.lit(k)) for k, w in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).join(total, "link").select("way", "link", "reason", "merged", "nodes")


def redelivery_quality(spark: SparkSession, d: str) -> DataFrame:
    """How the rule for publications finds the deliveries of one record again within a source, by candidates and by merge score.

    What is known: deliveries under one origin number are one record.  Works of unlike numbers with one title count as wrong.
    """
    b = load(spark, d)
    p, r = b.pubs, RULES["def_pubs"]
    values = stash(E.alike_phrases(p, None, "pub_name", "pub_name", r.must.min_sim).unionByName(E.alike_values(p, None, "year", "year", r.core.min_sim)).unionByName(E.alike_phrases(p, None, "venue", "venue", r.extra.min_sim)), "atomic")
    evidence = stash(E.pair_evidence(p, p, values, ["pub_name", "year", "venue"], "id", ordered=True, drive=["pub_name", "year"]), "evidence")
    side = p.select("id", "rec", "source")
    scored = E.accepted_pairs(evidence, r).select("r1", "r2").join(E.weighted_scores(evidence, r), ["r1", "r2"])
    scored = scored.join(side.select(F.col("id").alias("r1"), F.col("source").alias("s1")), "r1").join(side.select(F.col("id").alias("r2"), F.col("source").alias("s2")), "r2").where("s1 = s2")
    scored = stash(scored.select(F.col("r1").alias("a"), F.col("r2").alias("b"), "sim_attr"), "scored")
    same = side.select(F.col("id").alias("a"), "rec").join(side.select(F.col("id").alias("b"), "rec"), "rec").where("a < b").select("a", "b")
    tell = lambda df, name: df.select(F.lit(name).alias("link"), "a", "b")
    return quality(tell(scored, "candidates").unionByName(tell(scored.where(F.col("sim_attr") >= MERGE_T), "merged")), tell(same, "candidates").unionByName(tell(same, "merged")))


QUERIES = {"rule_publication_pairs": rule_publication_pairs, "resolved_bibliography": resolved_bibliography, "resolved_by_reason": resolved_by_reason, "redelivery_quality": redelivery_quality}
SQL: dict[str, str] = {}
