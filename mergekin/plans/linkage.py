"""Queries of the linkage operators on parts, publications and households."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin import standardise as S
from mergekin.config import MERGE_T, rule, rules
from mergekin.functions import columns as C
from mergekin.operators import evidence as E
from mergekin.operators import graphs as G
from mergekin.operators import names as N
from mergekin.functions.phonetic import SOUNDEX_DIGITS
from mergekin.operators.evaluate import quality, unique_keys
from mergekin.plans.basics import _AZ, _code, _runs, _sql_standard
from mergekin.session import read, stash
from mergekin.sources.tables import household_relations, linked_census

PARTS_RULE = rule("parts", "name", "size", "price", (1, 0, 0), 0.75, core_t=0.5, extra_t=0.5)


def _first_letters(w: Column) -> Column:
    """A block key that both engines can form: the soundex code of the word."""
    return C.soundex(F.regexp_replace(w, "[^a-z]", ""))


# --- parts: the smallest end-to-end pipeline ---------------------------------------------------------------------------


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", S.standard_string("p_name").alias("name"), "p_brand", "p_type", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def _part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(r1, r2, name, size, price): pairs of parts of one brand and type with names that the rule finds alike (edits), and their likenesses.

    Names are few, so their pairs are looked at once and parts are joined on alike names: parts of unlike names never meet.
    """
    p = _parts(spark, d)
    names = stash(p.select(F.col("name").alias("v")).where("v is not null").distinct(), "part-names")
    alike = E.alike_by_edits(names, PARTS_RULE.must.min_sim).withColumn("sim", C.edit_dist("v1", "v2")).where(F.col("sim") >= PARTS_RULE.must.min_sim)
    o = p.select(F.col("p_partkey").alias("r2"), F.col("name").alias("v2"), "p_brand", "p_type", F.col("size").alias("size2"), F.col("price").alias("price2"))
    # Every part's alike names come before the join: joined on all three columns, brand and type spread over the tasks by name.
    x = p.withColumnRenamed("p_partkey", "r1").join(alike.select(F.col("v1").alias("name"), "v2", "sim"), "name")
    j = x.join(o, ["p_brand", "p_type", "v2"]).where("r1 < r2")
    return j.select("r1", "r2", F.col("sim").alias("name"), C.abs_difference(F.col("size"), F.col("size2")).alias("size"), C.abs_difference(F.col("price"), F.col("price2"), 100).alias("price"))


def accepted_parts(spark: SparkSession, d: str) -> DataFrame:
    return E.accepted_wide(_part_pairs(spark, d), PARTS_RULE)


def linked_parts(spark: SparkSession, d: str) -> DataFrame:
    # The rule asks for the name only, and all these pairs have it alike.
    return E.weighted_wide(_part_pairs(spark, d), PARTS_RULE).where("sim_attr >= 0.6").select("r1", "r2", F.round("sim_attr", 6).alias("score"))


def ambiguous_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d)
    freq = N.combined_frequency(p, ["name", "p_brand"]).select("key", "freq")
    keyed = p.select("p_partkey", S.concat_key("name", "p_brand").alias("key")).join(freq, "key")
    total = p.count()
    amb = E.ambiguity(F.col("freq"), F.col("freq"), total)
    return keyed.select("p_partkey", "freq", F.round(amb, 6).alias("ambiguity"), F.round(E.combined_score(F.lit(0.9), amb, 0.7), 6).alias("combined"))


# --- bibliography ------------------------------------------------------------------------------------------------------


def _pubs(spark: SparkSession, d: str) -> DataFrame:
    """Publication records, each once, with standard values."""
    p = read(spark, d, "publication_dict").where("source in ('A', 'B')").dropDuplicates(["id"])
    return p.select("id", "source", "origin_id", S.standard_string("pub_name").alias("pub_name"), S.standard_string("venue").alias("venue"), F.when(F.col("year") > 0, F.col("year")).alias("year"))


def _surnames(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "people_dict").where("source in ('A', 'B')").dropDuplicates(["id"])
    return p.select("id", "pub_id", "source", S.standard_string("fname").alias("fname"), S.standard_string("sname").alias("sname"), "year")


def alike_surnames(spark: SparkSession, d: str) -> DataFrame:
    """Distinct surnames of the two sources in one phonetic block and at least 0.8 alike."""
    p = _surnames(spark, d)
    return E.alike_values(p.where("source = 'A'"), p.where("source = 'B'"), "sname", "sname", 0.8, C.edit_dist, _first_letters).select("v1", "v2", F.round("sim", 6).alias("sim"))


def alike_years(spark: SparkSession, d: str) -> DataFrame:
    p = _pubs(spark, d).where("year is not null")
    return E.alike_values(p.where("source = 'A'"), p.where("source = 'B'"), "year", "year", 0.8).select("v1", "v2", F.round("sim", 6).alias("sim"))


def _near_score(gap: Column) -> Column:
    """The score of publications of one title, by the years between."""
    return F.round(0.3 * (1 - gap / 10) + 0.7 * F.lit(1.0), 6)


def publication_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Publications of the two sources with the same standard title and alike years, with weighted scores."""
    p = _pubs(spark, d)
    a, b = p.where("source = 'A'"), p.where("source = 'B'")
    titles = a.select("pub_name").join(b.select("pub_name"), "pub_name").distinct().select(F.lit("pub_name").alias("attr"), F.col("pub_name").alias("v1"), F.col("pub_name").alias("v2"), F.lit(1.0).alias("sim"))
    years = E.alike_values(a, b, "year", "year", 0.8)
    atomic = titles.unionByName(years)
    r = rule("pubs", "pub_name", "year", "", (1, 1, 0), 0.9, core_t=0.8)
    evidence = stash(E.pair_evidence(a, b, atomic, ["pub_name", "year"], drive=E.driving(r)), "evidence")
    return E.accepted_pairs(evidence, r).select("r1", "r2").join(E.weighted_scores(evidence, r), ["r1", "r2"]).select("r1", "r2", F.round("sim_attr", 6).alias("score"))


def author_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Author pairs under accepted publication pairs: same surname, and first names that are equal or of which one is the other's initial."""
    return _author_pairs(spark, d, publication_pairs(spark, d))


def _author_pairs(spark: SparkSession, d: str, pubs: DataFrame) -> DataFrame:
    p = _surnames(spark, d).where("fname is not null and sname is not null").select("id", "pub_id", "fname", "sname")
    x = pubs.select("r1", "r2").join(p.select(F.col("pub_id").alias("r1"), F.col("id").alias("a1"), F.col("fname").alias("f1"), "sname"), "r1")
    y = x.join(p.select(F.col("pub_id").alias("r2"), F.col("id").alias("a2"), F.col("fname").alias("f2"), "sname"), ["r2", "sname"])
    initial = ((F.length("f1") == 1) | (F.length("f2") == 1)) & (F.substring("f1", 1, 1) == F.substring("f2", 1, 1))
    return y.where((F.col("f1") == F.col("f2")) | initial).select("r1", "r2", "a1", "a2", initial.alias("by_initial"))


def matched_publications(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one: every publication in one pair at most, best scores first."""
    p = _pubs(spark, d)
    # The pairs are those of publication_pairs: equal titles, years at least 0.8 alike, the score falling with the years between.
    best = G.one_to_one_near(p.where("source = 'A'"), p.where("source = 'B'"), "pub_name", "year", 2)
    return best.select("r1", "r2", _near_score(F.col("gap")).alias("score"))


def _bib_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Publication and author nodes in groups: each publication pair with its author pairs."""
    paired = stash(publication_pairs(spark, d), "pairs")
    pubs = paired.withColumn("group_id", F.xxhash64("r1", "r2"))
    years = _pubs(spark, d).select("id", "year")
    pubs = pubs.join(years.select(F.col("id").alias("r1"), F.col("year").alias("year1")), "r1").join(years.select(F.col("id").alias("r2"), F.col("year").alias("year2")), "r2")
    auth = _author_pairs(spark, d, paired).select(F.xxhash64("r1", "r2").alias("group_id"), F.col("a1").alias("r1"), F.col("a2").alias("r2"), F.when(F.col("by_initial"), 0.8).otherwise(1.0).alias("score"))
    a = auth.select("group_id", (-F.col("r1")).alias("r1"), (-F.col("r2")).alias("r2"), F.lit("A-A").alias("link"), F.col("score").alias("sim"), F.lit(None).cast("long").alias("year1"), F.lit(None).cast("long").alias("year2"))
    return pubs.select("group_id", "r1", "r2", F.lit("P-P").alias("link"), F.col("score").alias("sim"), F.col("year1").cast("long").alias("year1"), F.col("year2").cast("long").alias("year2")).unionByName(a)


def _author_groups(p: DataFrame, people: DataFrame) -> DataFrame:
    """The groups of _bib_nodes that have an author pair, without forming the publication pairs that have none."""
    known = people.where("fname is not null and sname is not null").select("pub_id", F.col("id").alias("a"), F.col("fname").alias("f"), "sname", F.substring("fname", 1, 1).alias("letter"))  # equal or an initial, they begin alike
    titled = p.where("pub_name is not null and year is not null").select(F.col("id").alias("pub_id"), F.col("source").alias("side"), "pub_name", F.col("year").cast("long").alias("year"))
    held = stash(titled.join(known, "pub_id").withColumnRenamed("pub_id", "r"), "held")
    of = lambda side, k: held.where(F.col("side") == side).drop("side").withColumnsRenamed({c: f"{c}{k}" for c in ("r", "year", "a", "f")})
    initial = (F.length("f1") == 1) | (F.length("f2") == 1)
    met = of("A", 1).join(of("B", 2), ["pub_name", "sname", "letter"]).where((F.abs(F.col("year1") - F.col("year2")) <= 2) & ((F.col("f1") == F.col("f2")) | initial))
    met = stash(met.select(F.xxhash64("r1", "r2").alias("group_id"), "r1", "r2", "year1", "year2", "a1", "a2", initial.alias("by_initial")), "author-pairs")
    pubs = met.select("group_id", "r1", "r2", F.lit("P-P").alias("link"), _near_score(F.abs(F.col("year1") - F.col("year2"))).alias("sim"), "year1", "year2").distinct()
    none = F.lit(None).cast("long")
    return pubs.unionByName(met.select("group_id", (-F.col("a1")).alias("r1"), (-F.col("a2")).alias("r2"), F.lit("A-A").alias("link"), F.when(F.col("by_initial"), 0.8).otherwise(1.0).alias("sim"), none.alias("year1"), none.alias("year2")))


def linked_bibliography(spark: SparkSession, d: str) -> DataFrame:
    """Greedy group linking: groups by size and mean, trimmed to their best part, each publication once; single pairs join at 0.9. Author ids are negative.

    Publication pairs without an author pair come last, all of them at 0.94 or more, and a group that loses its publication pair has lost one of the
    two publications to another; so they are those of singles_near() among the publications that the groups leave, and are not formed.
    """
    p = stash(_pubs(spark, d), "pubs")
    groups = stash(G.greedy_groups(_author_groups(p, _surnames(spark, d)), 0.85, None, ("P-P",)), "groups").select("group_id", "r1", "r2", "link", F.round("sim", 6).alias("sim"), "entity")
    free = p.join(groups.where("link = 'P-P'").select(F.explode(F.array("r1", "r2")).alias("id")), "id", "left_anti")
    alone = G.singles_near(free.where("source = 'A'"), free.where("source = 'B'"), "pub_name", "year", 2)
    return groups.unionByName(alone.select(F.xxhash64("r1", "r2").alias("group_id"), "r1", "r2", F.lit("P-P").alias("link"), _near_score(F.col("gap")).alias("sim"), F.least("r1", "r2").alias("entity")))


def trimmed_bibliography(spark: SparkSession, d: str) -> DataFrame:
    """The part of each group whose running mean stays at 0.95, before any constraint."""
    return G.trimmed_groups(_bib_nodes(spark, d), 0.95).select("r1", "r2", "link", F.round("sim", 6).alias("sim"))


def bibliography_groups(spark: SparkSession, d: str) -> DataFrame:
    return G.size_histogram(G.group_stats(_bib_nodes(spark, d)))


def dependency_bibliography(spark: SparkSession, d: str) -> DataFrame:
    """The dependency-graph baseline: a publication pair and its author pairs support each other weakly."""
    nodes = stash(_bib_nodes(spark, d).withColumn("node", F.xxhash64("group_id", "r1", "r2")), "bib")
    edges = G.relation_edges(nodes.select("node", F.col("group_id").alias("block"), F.col("link").alias("role")), lambda a, b: F.lit(False))
    out = G.dependency_linkage(nodes.select("node", F.col("sim").alias("sim_attr")), edges, MERGE_T)
    return nodes.join(out, "node").select("r1", "r2", "link", F.round("score", 6).alias("score"), "merged")


def translated_truth(spark: SparkSession, d: str) -> DataFrame:
    """Labelled pairs of source numbers as pairs of record ids."""
    p = read(spark, d, "publication_dict").select("id", "source", "origin_id").distinct()
    v = read(spark, d, "valid").where("label = 1").select("ltable_id", "rtable_id").distinct()
    x = v.join(p.where("source = 'A'").select(F.col("origin_id").alias("ltable_id"), F.col("id").alias("a")), "ltable_id")
    return x.join(p.where("source = 'B'").select(F.col("origin_id").alias("rtable_id"), F.col("id").alias("b")), "rtable_id").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_quality(spark: SparkSession, d: str) -> DataFrame:
    """Publication pairs against pairs of the same source numbers' titles word for word: the measures, not a claim about linkage."""
    pubs = publication_pairs(spark, d)
    p = _pubs(spark, d)
    truth = p.where("source = 'A'").select(F.col("id").alias("a"), "pub_name", "venue").join(p.where("source = 'B'").select(F.col("id").alias("b"), "pub_name", "venue"), ["pub_name", "venue"]).select(F.lit("P-P").alias("link"), "a", "b")
    return quality(pubs.select(F.lit("P-P").alias("link"), F.col("r1").alias("a"), F.col("r2").alias("b")), truth)


# --- names -------------------------------------------------------------------------------------------------------------


def _name_combos(spark: SparkSession, d: str) -> DataFrame:
    return N.combined_frequency(_surnames(spark, d).where("fname is not null and sname is not null"), ["sname", "fname"])


def name_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _name_combos(spark, d).select("key", "freq")


def name_variations(spark: SparkSession, d: str) -> DataFrame:
    return N.variations(stash(_name_combos(spark, d), "combos"), ["sname", "fname"], 0.85, C.edit_dist, _first_letters)


def clustered_names(spark: SparkSession, d: str) -> DataFrame:
    combos = stash(_name_combos(spark, d), "combos")
    return N.clustered_frequency(combos, N.variations(combos, ["sname", "fname"], 0.85, C.edit_dist, _first_letters))


# --- households --------------------------------------------------------------------------------------------------------


def _census(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return linked_census(read(spark, d, "couples_csv"))


def census_people(spark: SparkSession, d: str) -> DataFrame:
    people, _ = _census(spark, d)
    return people.groupBy("census_year", "role", "sex").agg(F.count("*").alias("n"), F.count("fname").alias("named"), F.count("bpl").alias("born"), F.count("occ").alias("working"))


def household_relatives(spark: SparkSession, d: str) -> DataFrame:
    people, _ = _census(spark, d)
    return household_relations(people).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("record").alias("records"))


def _household_evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(people, pairs) of persons of the two censuses with the same role, surname, race and birthplace, close in age."""
    people, _ = _census(spark, d)
    people = stash(people, "people").where("role is not null and sname is not null")
    x = people.where("census_year = 1870").select(*[F.col(c).alias(f"{c}_1") for c in ("id", "serial", "fname", "birth_year", "occ", "state")], "role", "sname", "race", "bpl")
    y = people.where("census_year = 1880").select(*[F.col(c).alias(f"{c}_2") for c in ("id", "serial", "fname", "birth_year", "occ", "state")], "role", "sname", "race", "bpl")
    pairs = x.join(y, ["role", "sname", "race", "bpl"]).where(F.coalesce(F.abs(F.col("birth_year_1") - F.col("birth_year_2")) <= 2, F.lit(True)))
    return people, pairs


def household_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Person pairs of the two censuses with equal surname, role, race and birthplace and alike first names, close in age."""
    _, pairs = _household_evidence(spark, d)
    good = pairs.withColumn("sim", C.edit_dist("fname_1", "fname_2")).where("sim >= 0.7")
    return good.select(F.col("id_1").alias("r1"), F.col("id_2").alias("r2"), "role", "serial_1", "serial_2", F.round("sim", 6).alias("sim"))


def _rule_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, links, pairs (r1, r2, role, sim)) of persons of the two censuses under the rule for households, with alike names.

    Pairs arise from alike surnames with alike first names, or with equal birthplace and a birth year within the comparator's reach; so a surname
    or birthplace that very many persons have does not pair them all.  An unknown birthplace is no evidence.
    """
    people, links = _census(spark, d)
    people = stash(people.where("role is not null and sname is not null"), "people")
    r = rules()["def_hh_link"]
    x, y = (people.where(F.col("census_year") == k).select("id", "role", "sname", "fname", "bpl", "race", F.col("birth_year").cast("string").alias("birth_year"), "state", "occ") for k in (1870, 1880))
    values = E.alike_values(x, y, "sname", "sname", r.must.min_sim).unionByName(E.alike_values(x, y, "fname", "fname", r.must.min_sim)).unionByName(E.alike_values(x, y, "birth_year", "birth_year", r.core.min_sim))
    for c in ("bpl", "race", "state", "occ"):  # codes are alike if they are equal
        both = x.select(c).join(y.select(c), c).distinct()
        values = values.unionByName(both.select(F.lit(c).alias("attr"), F.col(c).alias("v1"), F.col(c).alias("v2"), F.lit(1.0).alias("sim")))
    values = stash(values, "values")
    drive = lambda *a: E.pair_evidence(x, y, values, list(a), drive=list(a)).select("r1", "r2")
    pairs = stash(drive("sname", "fname").unionByName(drive("sname", "bpl", "birth_year")).distinct(), "pairs")
    roles = people.select("id", "role")
    pairs = pairs.join(roles.select(F.col("id").alias("r1"), "role"), "r1").join(roles.select(F.col("id").alias("r2"), F.col("role").alias("role2")), "r2").where("role = role2").select("r1", "r2", "role")
    evidence = stash(E.evidence_of(pairs, x, y, values, list(r.category_of())), "evidence")
    scored = E.accepted_pairs(evidence, r).select("r1", "r2").join(E.weighted_scores(evidence, r), ["r1", "r2"])
    return people, links, stash(pairs.join(scored, ["r1", "r2"]).select("r1", "r2", "role", F.col("sim_attr").alias("sim")), "household-nodes")


def rule_household_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Person pairs of the two censuses under the rule for households."""
    return _rule_pairs(spark, d)[2].select("r1", "r2", "role", F.round("sim", 6).alias("sim"))


def rule_census_quality(spark: SparkSession, d: str) -> DataFrame:
    """How the rule for households finds the persons that the census table itself links: all candidates, and one to one in groups of households."""
    people, links, pairs = _rule_pairs(spark, d)
    of = people.select("id", "serial")
    found = pairs.join(of.select(F.col("id").alias("r1"), F.col("serial").alias("s1")), "r1").join(of.select(F.col("id").alias("r2"), F.col("serial").alias("s2")), "r2")
    # Every further pair of the same two households supports a pair.
    support = found.groupBy("s1", "s2").agg(F.count_distinct("r1").alias("n"))
    chosen = G.one_to_one(found.join(support, ["s1", "s2"]).withColumn("score", F.round(F.col("sim") + 0.1 * F.least(F.col("n") - 1, F.lit(5)), 9)), "score").select("r1", "r2")
    known = links.join(people.select(F.col("id").alias("a"), "role"), "a").select("a", "b")
    tell = lambda df, name: df.select(F.lit(name).alias("link"), *[F.col(c).alias(n) for c, n in zip(df.columns[:2], ("a", "b"), strict=True)])
    return quality(tell(pairs, "candidates").unionByName(tell(chosen, "linked")), tell(known, "candidates").unionByName(tell(known, "linked")))


def linked_households(spark: SparkSession, d: str) -> DataFrame:
    """Household pairs by the number and mean of their person pairs, one to one."""
    nodes = household_pairs(spark, d)
    sums = nodes.groupBy("serial_1", "serial_2").agg(F.count("*").alias("n"), F.avg("sim").alias("mean"))
    return G.one_to_one(sums.withColumn("score", F.round(F.col("n") + F.col("mean"), 9)), "score", "serial_1", "serial_2")


def refined_household_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Relatives' pairs that follow from matched couples: children need a score, mothers and fathers none."""
    nodes = stash(household_pairs(spark, d), "nodes")
    best = G.one_to_one(nodes.where("role in ('F', 'M')"), "sim")
    members = G.membership(best)
    people, _ = _census(spark, d)
    return G.related_pairs(members, household_relations(people), nodes.select("r1", "r2", "sim"), 0.8).select("r1", "r2", "relation")


def census_quality(spark: SparkSession, d: str) -> DataFrame:
    people, links = _census(spark, d)
    role = people.select(F.col("id").alias("a"), "role")
    truth = links.join(role, "a").where("role is not null").select(F.concat_ws("-", "role", "role").alias("link"), "a", "b")
    found = G.one_to_one(household_pairs(spark, d), "sim").join(role.withColumnRenamed("a", "r1"), "r1").select(F.concat_ws("-", "role", "role").alias("link"), F.col("r1").alias("a"), F.col("r2").alias("b"))
    return quality(found, truth)


def unique_people(spark: SparkSession, d: str) -> DataFrame:
    """Persons of the first census whose names and birth year occur once, joined to the second on the same."""
    people, _ = _census(spark, d)
    keys = ["fname", "sname", "birth_year"]
    one = lambda y: unique_keys(people.where(F.col("census_year") == y).select("id", *keys), keys)
    return one(1870).withColumnRenamed("id", "a").join(one(1880).withColumnRenamed("id", "b"), keys).select("a", "b")


QUERIES = {
    "linked_parts": linked_parts, "accepted_parts": accepted_parts, "ambiguous_parts": ambiguous_parts, "alike_surnames": alike_surnames, "alike_years": alike_years, "publication_pairs": publication_pairs,
    "author_pairs": author_pairs, "matched_publications": matched_publications, "linked_bibliography": linked_bibliography, "trimmed_bibliography": trimmed_bibliography, "bibliography_groups": bibliography_groups,
    "dependency_bibliography": dependency_bibliography, "translated_truth": translated_truth, "link_quality": link_quality, "name_frequencies": name_frequencies, "name_variations": name_variations,
    "clustered_names": clustered_names, "census_people": census_people, "household_relatives": household_relatives, "household_pairs": household_pairs, "linked_households": linked_households,
    "refined_household_pairs": refined_household_pairs, "census_quality": census_quality, "rule_household_pairs": rule_household_pairs, "rule_census_quality": rule_census_quality, "unique_people": unique_people,
}


# --- the same in SQL ---------------------------------------------------------------------------------------------------


def _letters(x: str) -> str:
    """DuckDB counts the bytes of accented letters, so each becomes a sign of one byte that no standard value has."""
    return f"translate({x}, 'éöüäáàâèêëíïîóôúûçñßåøæý', '!#$%&()*+,-./:;<=>?@[]^_')"


def _edit(a: str, b: str) -> str:
    return f"(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE 1 - levenshtein({_letters(a)}, {_letters(b)})::DOUBLE / greatest(length({a}), length({b})) END)"


def _mad(a: str, b: str, most: int = 10) -> str:
    return f"(CASE WHEN abs({a} - {b}) <= {most} THEN 1 - abs({a} - {b}) / {most}.0::DOUBLE ELSE 0.0 END)"


def _soundex(word: str) -> str:
    w = f"regexp_replace({word}, '[^a-z]', '', 'g')"
    return f"(CASE WHEN {w} = '' THEN '0000' ELSE substring(rpad(substring({w}, 1, 1) || replace({_runs(f"translate(replace(substring({w}, 2), ' ', ''), '{_AZ}', '{SOUNDEX_DIGITS}')")}, '0', ''), 4, '0'), 1, 4) END)"


_PART = f"""
    WITH p AS (SELECT *, {_sql_standard('p_name')} AS name FROM part),
    s AS (SELECT a.p_partkey AS r1, b.p_partkey AS r2, {_edit('a.name', 'b.name')} AS name, {_mad('a.p_size', 'b.p_size')} AS size, {_mad('a.p_retailprice', 'b.p_retailprice', 100)} AS price
          FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey)"""
_BIB = f"""
    p AS (SELECT DISTINCT id, source, origin_id, {_sql_standard('pub_name')} AS pub_name, {_sql_standard('venue')} AS venue, CASE WHEN year > 0 THEN year END AS year FROM publication_dict),
    pp AS (SELECT a.id AS r1, b.id AS r2, round(0.3 * {_mad('a.year', 'b.year')} + 0.7, 6) AS score FROM p a JOIN p b ON a.source = 'A' AND b.source = 'B' AND a.pub_name = b.pub_name AND abs(a.year - b.year) <= 2),
    au AS (SELECT DISTINCT id, pub_id, {_sql_standard('fname')} AS fname, {_sql_standard('sname')} AS sname FROM people_dict WHERE source IN ('A', 'B')),
    ap AS (SELECT r1, r2, x.id AS a1, y.id AS a2, x.fname IS DISTINCT FROM y.fname OR length(x.fname) = 1 AS by_initial
           FROM pp JOIN au x ON x.pub_id = r1 JOIN au y ON y.pub_id = r2 AND y.sname = x.sname
           WHERE x.fname = y.fname OR ((length(x.fname) = 1 OR length(y.fname) = 1) AND substring(x.fname, 1, 1) = substring(y.fname, 1, 1)))"""
_NAMES = f"""
    n AS (SELECT DISTINCT id, {_sql_standard('fname')} AS fname, {_sql_standard('sname')} AS sname FROM people_dict WHERE source IN ('A', 'B')),
    c AS (SELECT sname || '-' || fname AS key, sname, fname, count(*) AS freq, {_soundex('sname')} AS block FROM n WHERE fname IS NOT NULL AND sname IS NOT NULL GROUP BY sname, fname),
    v AS (SELECT a.key, b.key AS other FROM c a JOIN c b ON a.block = b.block AND a.key <> b.key WHERE {_edit('a.sname', 'b.sname')} >= 0.85 AND {_edit('a.fname', 'b.fname')} >= 0.85)"""


def _census_side(n: int) -> str:
    code = lambda f: _code(f"{f}_{n}")
    known = lambda f, unknown: f"CASE WHEN {code(f)} NOT IN ({unknown}) THEN {code(f)} END"
    return f"""SELECT concat_ws('-', year_{n}, serial_{n}, pernum_{n}) AS id, year_{n} AS census_year, serial_{n} AS serial, pernum_{n} AS pernum,
        CASE WHEN {code('relate')} IN ('1', '2') THEN CASE {code('sex')} WHEN '2' THEN 'M' WHEN '1' THEN 'F' END WHEN {code('relate')} = '3' THEN 'C' END AS role,
        CASE {code('sex')} WHEN '1' THEN 'M' WHEN '2' THEN 'F' END AS sex, {_sql_standard(f'namefrst_{n}')} AS fname, {_sql_standard(f'namelast_{n}')} AS sname,
        CAST(year_{n} - CAST(trunc(TRY_CAST({code('age')} AS DOUBLE)) AS INTEGER) AS INTEGER) AS birth_year, {code('race')} AS race, {known('bpl', "'999'")} AS bpl, {known('stateicp', "'99'")} AS state, {known('city', "'0'")} AS city,
        {known('occ1950', "'995', '997', '999'")} AS occ FROM kept WHERE serial_{n} IS NOT NULL"""


_FIELDS = ["census_year", "serial", "pernum", "role", "sex", "fname", "sname", "birth_year", "race", "bpl", "state", "city", "occ"]
_CENSUS = f"""
    kept AS (SELECT * FROM couples_csv WHERE {_code('relate_1')} IN ('1', '2', '3') AND (coalesce({_code('relate_1')} = {_code('relate_2')}, false) OR relate_2 IS NULL)),
    sides AS ({_census_side(1)} UNION ALL {_census_side(2)}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(fname, ''), coalesce(sname, ''), coalesce(occ, ''), coalesce(city, ''), coalesce(state, ''), coalesce(birth_year, 0)) AS k FROM sides),
    people AS (SELECT * FROM ranked WHERE k = 1)"""
_HOUSEHOLDS = f"""
    hp AS (SELECT a.id AS r1, b.id AS r2, a.role, a.serial AS serial_1, b.serial AS serial_2, {_edit('a.fname', 'b.fname')} AS sim FROM people a JOIN people b
           ON a.census_year = 1870 AND b.census_year = 1880 AND a.role = b.role AND a.sname = b.sname AND a.race = b.race AND a.bpl = b.bpl
           WHERE coalesce(abs(a.birth_year - b.birth_year) <= 2, true) AND {_edit('a.fname', 'b.fname')} >= 0.7)"""
_MEASURES = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp > 0 THEN round(tp * 100.0::DOUBLE / (tp + fp), 2) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN round(tp * 100.0::DOUBLE / (tp + fn), 2) ELSE 0.0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN round(tp * 100.0::DOUBLE / (tp + fp + fn), 2) ELSE 0.0 END AS f_star"""



def sql_one_to_one(pairs: str) -> str:
    """CTEs o (numbered pairs, best first) and g (the greedy matching, a pair a step) of a relation pairs (l, r, s)."""
    return f"""o AS (SELECT row_number() OVER (ORDER BY s DESC, l, r) AS k, l, r, s FROM (SELECT l, r, max(s) AS s FROM {pairs} WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY l, r)),
    g AS (SELECT o.k, o.l, o.r, o.s, true AS ok, [o.l] AS ul, [o.r] AS ur FROM o WHERE k = 1 UNION ALL
        SELECT k, l, r, s, ok, CASE WHEN ok THEN list_append(ul, l) ELSE ul END, CASE WHEN ok THEN list_append(ur, r) ELSE ur END
        FROM (SELECT o.k, o.l, o.r, o.s, g.ul, g.ur, NOT (list_contains(g.ul, o.l) OR list_contains(g.ur, o.r)) AS ok FROM g JOIN o ON o.k = g.k + 1))"""


_CENSUS_TRUTH = """
    lk AS (SELECT DISTINCT concat_ws('-', year_1, serial_1, pernum_1) AS a, concat_ws('-', year_2, serial_2, pernum_2) AS b FROM kept WHERE serial_1 IS NOT NULL AND serial_2 IS NOT NULL AND linktype <> '9'),
    t AS (SELECT DISTINCT role || '-' || role AS link, least(a, b) AS a, greatest(a, b) AS b FROM lk JOIN people ON people.id = lk.a WHERE role IS NOT NULL)"""


def _sql_quality(found: str) -> str:
    """The measures by link of relations found and t (link, a, b)."""
    return f"""f AS (SELECT DISTINCT link, least(a, b) AS a, greatest(a, b) AS b FROM {found}), fo AS (SELECT link, count(*) FILTER (x AND y) AS tp, count(*) FILTER (NOT y) AS fp, count(*) FILTER (NOT x) AS fn
        FROM (SELECT coalesce(f.link, t.link) AS link, f.a IS NOT NULL AS x, t.a IS NOT NULL AS y FROM f FULL JOIN t ON f.link = t.link AND f.a = t.a AND f.b = t.b) GROUP BY 1) SELECT link, {_MEASURES} FROM fo"""


SQL = {
    "matched_publications": f"WITH RECURSIVE {_BIB}, pairs AS (SELECT r1 AS l, r2 AS r, score AS s FROM pp), {sql_one_to_one('pairs')} SELECT l AS r1, r AS r2, s AS score FROM g WHERE ok",
    "linked_households": f"""
        WITH RECURSIVE {_CENSUS}, {_HOUSEHOLDS}, pairs AS (SELECT serial_1 AS l, serial_2 AS r, round(count(*) + avg(round(sim, 6)), 9) AS s FROM hp GROUP BY 1, 2), {sql_one_to_one('pairs')}
        SELECT l AS serial_1, r AS serial_2, s AS score FROM g WHERE ok""",
    "refined_household_pairs": f"""
        WITH RECURSIVE {_CENSUS}, {_HOUSEHOLDS}, pairs AS (SELECT r1 AS l, r2 AS r, round(sim, 6) AS s FROM hp WHERE role IN ('F', 'M')), {sql_one_to_one('pairs')},
        rel AS (SELECT a.id AS record, b.id AS other, CASE WHEN a.role <> 'C' AND b.role <> 'C' THEN 'spouse' WHEN a.role = 'C' AND b.role = 'M' THEN 'mother' WHEN a.role = 'C' AND b.role = 'F' THEN 'father' WHEN a.role <> 'C' THEN 'child' ELSE 'sibling' END AS relation
            FROM people a JOIN people b ON a.census_year = b.census_year AND a.serial = b.serial AND a.id <> b.id WHERE a.role IS NOT NULL AND b.role IS NOT NULL)
        SELECT DISTINCT hp.r1, hp.r2, x.relation FROM g JOIN rel x ON x.record = g.l JOIN rel y ON y.record = g.r AND y.relation = x.relation JOIN hp ON hp.r1 = x.other AND hp.r2 = y.other
        WHERE g.ok AND (x.relation IN ('mother', 'father') OR round(hp.sim, 6) >= 0.8)""",
    "census_quality": f"""
        WITH RECURSIVE {_CENSUS}, {_HOUSEHOLDS}, {_CENSUS_TRUTH}, pairs AS (SELECT r1 AS l, r2 AS r, round(sim, 6) AS s FROM hp), {sql_one_to_one('pairs')},
        found AS (SELECT role || '-' || role AS link, l AS a, r AS b FROM g JOIN people ON people.id = g.l WHERE ok), {_sql_quality('found')}""",
    "linked_parts": _PART + """, m AS (SELECT *, (CASE WHEN size >= 0.5 THEN size ELSE 0 END) AS core FROM s WHERE name >= 0.75),
        w AS (SELECT r1, r2, CASE WHEN price >= 0.5 THEN 0.2 * core + 0.6 * name + 0.2 * price ELSE 0.3 * core + 0.7 * name END AS sim FROM m)
        SELECT r1, r2, round(sim, 6) AS score FROM w WHERE sim >= 0.6""",
    "accepted_parts": _PART + "SELECT r1, r2, CAST(1 AS BIGINT) AS n_must, CAST(size >= 0.5 AS BIGINT) AS n_core, CAST(price >= 0.5 AS BIGINT) AS n_extra FROM s WHERE name >= 0.75",
    "ambiguous_parts": f"""
        WITH p AS (SELECT p_partkey, coalesce({_sql_standard('p_name')}, 'None') || '-' || coalesce(p_brand, 'None') AS key FROM part), f AS (SELECT key, count(*) AS freq FROM p GROUP BY key), n AS (SELECT count(*) AS n FROM p)
        SELECT p_partkey, freq, round(1 - ln(2 * freq) / ln(n), 6) AS ambiguity, round(0.7 * 0.9 + 0.3 * (1 - ln(2 * freq) / ln(n)), 6) AS combined FROM p JOIN f USING (key), n""",
    "alike_surnames": f"""
        WITH n AS (SELECT DISTINCT source, {_sql_standard('sname')} AS v FROM people_dict), a AS (SELECT v FROM n WHERE source = 'A' AND v IS NOT NULL), b AS (SELECT v FROM n WHERE source = 'B' AND v IS NOT NULL),
        x AS (SELECT DISTINCT v, {_soundex('w')} AS block FROM (SELECT v, unnest(string_split(v, ' ')) AS w FROM a)), y AS (SELECT DISTINCT v, {_soundex('w')} AS block FROM (SELECT v, unnest(string_split(v, ' ')) AS w FROM b)),
        j AS (SELECT DISTINCT x.v AS v1, y.v AS v2 FROM x JOIN y USING (block) WHERE x.v <> y.v)
        SELECT v1, v2, round({_edit('v1', 'v2')}, 6) AS sim FROM j WHERE {_edit('v1', 'v2')} >= 0.8 UNION ALL SELECT a.v, a.v, 1.0 FROM a JOIN b ON a.v = b.v""",
    "alike_years": f"""
        WITH a AS (SELECT DISTINCT year FROM publication_dict WHERE source = 'A' AND year > 0), b AS (SELECT DISTINCT year FROM publication_dict WHERE source = 'B' AND year > 0)
        SELECT CAST(a.year AS VARCHAR) AS v1, CAST(b.year AS VARCHAR) AS v2, round({_mad('a.year', 'b.year')}, 6) AS sim FROM a, b WHERE abs(a.year - b.year) <= 2""",
    "publication_pairs": f"WITH {_BIB} SELECT r1, r2, score FROM pp",
    "author_pairs": f"WITH {_BIB} SELECT r1, r2, a1, a2, (length(x.fname) = 1 OR length(y.fname) = 1) AND substring(x.fname, 1, 1) = substring(y.fname, 1, 1) AS by_initial FROM ap JOIN au x ON x.id = a1 JOIN au y ON y.id = a2",
    "trimmed_bibliography": f"""
        WITH {_BIB}, nodes AS (SELECT r1 AS g1, r2 AS g2, r1, r2, 'P-P' AS link, score AS sim FROM pp UNION ALL
            SELECT r1, r2, -a1, -a2, 'A-A', CASE WHEN (length(x.fname) = 1 OR length(y.fname) = 1) AND substring(x.fname, 1, 1) = substring(y.fname, 1, 1) THEN 0.8 ELSE 1.0 END FROM ap JOIN au x ON x.id = a1 JOIN au y ON y.id = a2),
        r AS (SELECT *, avg(sim) OVER w AS m, row_number() OVER w AS k FROM nodes WINDOW w AS (PARTITION BY g1, g2 ORDER BY sim DESC, r1, r2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        best AS (SELECT g1, g2, max(CASE WHEN m >= 0.95 THEN k END) AS keep FROM r GROUP BY g1, g2)
        SELECT r1, r2, link, round(sim, 6)::DOUBLE AS sim FROM r JOIN best USING (g1, g2) WHERE keep >= 2 AND k <= keep""",
    # Nodes of a group support each other alike, so those merge that stand before the first, best first, whom those before it do not lift far enough.
    "dependency_bibliography": f"""
        WITH {_BIB}, nodes AS (SELECT r1 AS g1, r2 AS g2, r1, r2, 'P-P' AS link, score::DOUBLE AS sim FROM pp UNION ALL
            SELECT r1, r2, -a1, -a2, 'A-A', CASE WHEN (length(x.fname) = 1 OR length(y.fname) = 1) AND substring(x.fname, 1, 1) = substring(y.fname, 1, 1) THEN 0.8 ELSE 1.0 END FROM ap JOIN au x ON x.id = a1 JOIN au y ON y.id = a2),
        k AS (SELECT *, row_number() OVER (PARTITION BY g1, g2 ORDER BY sim DESC, link, r1, r2) AS k FROM nodes), o AS (SELECT *, CASE WHEN 0.9::DOUBLE * sim + 0.05::DOUBLE * (k - 1) >= 0.85 THEN 1 ELSE 0 END AS ok FROM k),
        m AS (SELECT *, min(ok) OVER (PARTITION BY g1, g2 ORDER BY k) = 1 AS merged FROM o), n AS (SELECT *, count(*) FILTER (merged) OVER (PARTITION BY g1, g2) AS c FROM m)
        SELECT r1, r2, link, round(0.9::DOUBLE * sim + 0.05::DOUBLE * (c - CAST(merged AS INTEGER)), 6) AS score, merged FROM n""",
    "bibliography_groups": f"""
        WITH {_BIB}, n AS (SELECT r1, r2, 1 + (SELECT count(*) FROM ap WHERE ap.r1 = pp.r1 AND ap.r2 = pp.r2) AS size FROM pp) SELECT size, count(*) AS groups FROM n GROUP BY size""",
    "translated_truth": """
        SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM valid v JOIN publication_dict a ON a.source = 'A' AND a.origin_id = v.ltable_id JOIN publication_dict b ON b.source = 'B' AND b.origin_id = v.rtable_id WHERE v.label = 1""",
    "link_quality": f"""
        WITH {_BIB}, f AS (SELECT DISTINCT least(r1, r2) AS a, greatest(r1, r2) AS b FROM pp), t AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM p x JOIN p y ON x.source = 'A' AND y.source = 'B' AND x.pub_name = y.pub_name AND x.venue = y.venue),
        c AS (SELECT (SELECT count(*) FROM f JOIN t USING (a, b)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM t) AS nt), d AS (SELECT tp, nf - tp AS fp, nt - tp AS fn FROM c)
        SELECT 'P-P' AS link, {_MEASURES} FROM d""",
    "name_frequencies": f"WITH {_NAMES} SELECT key, freq FROM c",
    "name_variations": f"WITH {_NAMES} SELECT key, other FROM v",
    "clustered_names": f"WITH {_NAMES}, m AS (SELECT v.key, sum(c.freq) AS more FROM v JOIN c ON c.key = v.other GROUP BY v.key) SELECT c.key, CAST(c.freq + coalesce(m.more, 0) AS BIGINT) AS freq FROM c LEFT JOIN m USING (key)",
    "census_people": f"WITH {_CENSUS} SELECT census_year, role, sex, count(*) AS n, count(fname) AS named, count(bpl) AS born, count(occ) AS working FROM people GROUP BY census_year, role, sex",
    "household_relatives": f"""
        WITH {_CENSUS}, j AS (SELECT a.id AS record, b.id AS other, CASE WHEN a.role <> 'C' AND b.role <> 'C' THEN 'spouse' WHEN a.role = 'C' AND b.role = 'M' THEN 'mother' WHEN a.role = 'C' AND b.role = 'F' THEN 'father' WHEN a.role <> 'C' THEN 'child' ELSE 'sibling' END AS relation
            FROM people a JOIN people b ON a.census_year = b.census_year AND a.serial = b.serial AND a.id <> b.id WHERE a.role IS NOT NULL AND b.role IS NOT NULL)
        SELECT relation, count(*) AS n, count(DISTINCT record) AS records FROM j GROUP BY relation""",
    "household_pairs": f"WITH {_CENSUS}, {_HOUSEHOLDS} SELECT r1, r2, role, serial_1, serial_2, round(sim, 6) AS sim FROM hp",
    "unique_people": f"""
        WITH {_CENSUS}, u AS (SELECT *, count(*) OVER (PARTITION BY census_year, fname, sname, birth_year) AS c FROM people WHERE fname IS NOT NULL AND sname IS NOT NULL AND birth_year IS NOT NULL)
        SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.census_year = 1870 AND b.census_year = 1880 AND a.c = 1 AND b.c = 1 AND a.fname = b.fname AND a.sname = b.sname AND a.birth_year = b.birth_year""",
}
