"""Queries of the reports: counts, trends, histograms, weights and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin import standardise as S
from mergekin.functions import columns as C
from mergekin.operators import evaluate as V
from mergekin.operators import graphs as G
from mergekin.plans.basics import _code
from mergekin.plans.linkage import _CENSUS, _MEASURES, _census, _edit, _mad
from mergekin.predicates import CIVIL_LINKS
from mergekin.session import read, stash


def people_types(spark: SparkSession, d: str) -> DataFrame:
    people, _ = _census(spark, d)
    return V.type_counts(people)


def year_trend(spark: SparkSession, d: str) -> DataFrame:
    """Publications a year, over every year from the first to the last that is known."""
    p = read(spark, d, "publication_dict").where("year > 0")
    span = p.agg(F.coalesce(F.min("year"), F.lit(1)).alias("a"), F.coalesce(F.max("year"), F.lit(0)).alias("b")).first()
    return V.yearly_trend(p, F.col("year"), span.a, span.b)


def linked_age_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "couples_csv").select("couple_id", F.expr("try_cast(age_1 as double)").alias("a"), F.expr("try_cast(age_2 as double)").alias("b")).distinct()
    return V.gap_histogram(c, F.col("a"), F.col("b"))


def venue_description(spark: SparkSession, d: str) -> DataFrame:
    return V.describe(read(spark, d, "publication_dict"), "venue")


def feed_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.value_counts(read(spark, d, "publication_dict"), "feed")


def initial_only_authors(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "people_dict").select("id", "source", S.plain_or_null("fname").alias("fname"), S.plain_or_null("sname").alias("sname")).distinct()
    count = lambda c: F.count(F.when(c, 1))
    return p.groupBy("source").agg(F.count("*").alias("n"), count(F.col("fname").isNull()).alias("no_fname"), count(F.col("sname").isNull()).alias("no_sname"), count(F.length("fname") == 1).alias("initial_only"))


def person_id_parts(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "couples_csv").select(F.concat_ws("-", "year_1", "serial_1", "pernum_1").alias("id"))
    return V.id_parts(c, "id")


def publication_years(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "publication_dict").where("year > 0")
    return p.groupBy("source").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count_if(F.col("year").between(1990, 1999)).alias("nineties"))


def shared_households(spark: SparkSession, d: str) -> DataFrame:
    """Household numbers of the first census by the kinds of relation they hold: each kind, and both."""
    c = read(spark, d, "couples_csv").select("serial_1", S.census_text("relate_1").alias("rel"))
    couples, children = c.where("rel in ('1', '2')").select("serial_1"), c.where("rel = '3'").select("serial_1")
    one = lambda df, name: df.distinct().agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return one(couples, "couples").unionByName(one(children, "children")).unionByName(one(couples.intersect(children), "both")).unionByName(one(couples.unionByName(children), "any"))


def link_types(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "couples_csv").select("couple_id", "serial_1", "linktype").distinct()
    per = c.groupBy("linktype").agg(F.count("*").alias("persons"), F.count_distinct("serial_1").alias("households"))
    return per.withColumn("mean_size", F.round(F.col("persons") / F.col("households"), 6)).withColumn("linked", F.col("linktype") != "9")


def linked_attributes(spark: SparkSession, d: str) -> DataFrame:
    """How alike the attributes of linked persons are: one row per attribute."""
    c = read(spark, d, "couples_csv").where("linktype <> '9'").dropDuplicates(["couple_id"])
    text = lambda f: (S.standard_string(f"{f}_1"), S.standard_string(f"{f}_2"))
    sim = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), C.edit_dist(a, b))
    age = C.abs_difference(F.expr("try_cast(age_1 as double)") + 10, F.expr("try_cast(age_2 as double)"))
    sims = F.array(*[F.struct(F.lit(f).alias("attr"), sim(*text(f)).alias("sim")) for f in ("namefrst", "namelast")], F.struct(F.lit("age").alias("attr"), age.alias("sim")))
    return V.attribute_report(c.select(F.lit("1870-1880").alias("link"), F.explode(sims).alias("x")).select("link", "x.attr", "x.sim"))


def agreement_weights(spark: SparkSession, d: str) -> DataFrame:
    """m and u probabilities and weights of census attributes: linked persons against the next person of the same household."""
    c = read(spark, d, "couples_csv").where("linktype <> '9'").dropDuplicates(["couple_id"])
    fields = ["sex", "race", "bpl", "stateicp"]
    own = c.select(F.lit(True).alias("matched"), *[x for f in fields for x in (S.census_code(f"{f}_1", f).alias(f"{f}_1"), S.census_code(f"{f}_2", f).alias(f"{f}_2"))])
    x = c.select("serial_1", F.col("pernum_1").alias("p"), *[S.census_code(f"{f}_1", f).alias(f"{f}_1") for f in fields])
    y = c.select("serial_1", (F.col("pernum_1") - 1).alias("p"), *[S.census_code(f"{f}_2", f).alias(f"{f}_2") for f in fields])
    other = x.join(y, ["serial_1", "p"]).select(F.lit(False).alias("matched"), *own.columns[1:])
    w = V.match_weights(own.unionByName(other), fields)
    return w.select("attr", *[F.round(k, 6).alias(k) for k in ("m", "u", "w_agree", "w_disagree")])


def label_quality(spark: SparkSession, d: str) -> DataFrame:
    """Pairs labelled as matches, each of the two years of decision against the other."""
    v = read(spark, d, "valid").where("label = 1 and ltable_id is not null and rtable_id is not null")
    pair = lambda df: df.select(F.lit("P-P").alias("link"), (F.col("ltable_id") * 2).alias("a"), (F.col("rtable_id") * 2 + 1).alias("b"))
    return V.quality(pair(v.where("month(decided_at) <= 3")), pair(v.where("month(decided_at) >= 3")))


def miss_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why linked persons of the censuses are no candidate pair: different surname or role, or unlike first names."""
    c = read(spark, d, "couples_csv").where("linktype <> '9'").dropDuplicates(["couple_id"])
    one = c.select("couple_id", S.standard_string("namelast_1").alias("l1"), S.standard_string("namelast_2").alias("l2"), S.standard_string("namefrst_1").alias("f1"), S.standard_string("namefrst_2").alias("f2"))
    link = F.lit("1-2").alias("link")
    truth = one.select(link, F.col("couple_id").alias("a"), (-F.col("couple_id")).alias("b"))
    cand = one.where("l1 = l2").select(link, F.col("couple_id").alias("a"), (-F.col("couple_id")).alias("b"))
    scored = one.select(F.col("couple_id").alias("a"), (-F.col("couple_id")).alias("b"), C.edit_dist("f1", "f2").alias("sim"))
    return V.miss_reasons(truth, cand, scored, 0.7)


def match_components(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the groups that the matches of the labelled pairs form, and how many groups have each."""
    v = read(spark, d, "valid").where("label = 1").select((F.col("ltable_id") * 2).alias("a"), (F.col("rtable_id") * 2 + 1).alias("b"))
    return V.entity_sizes(G.components(v, "a", "b").select(F.col("v").alias("record"), F.col("component").alias("entity")))


def trimmed_parts(spark: SparkSession, d: str) -> DataFrame:
    """The best orders of each customer whose running mean of price stays at 200,000."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return G.trimmed_groups(o, 200_000.0, "o_custkey", "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey")


def sparse_records(spark: SparkSession, d: str) -> DataFrame:
    """The members that the density rule removes from thinly linked groups: nations (from 0) and order priorities (below 0) that orders of a month link."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return G.sparse_members(o.select(month.alias("entity"), F.col("c_nationkey").cast("int").alias("r1"), (-F.substring("o_orderpriority", 1, 1).cast("int")).alias("r2")))


def bridged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the labelled pairs' groups that are left when bridges of groups of at least ten records go."""
    v = stash(read(spark, d, "valid").where("label = 1 and ltable_id is not null and rtable_id is not null").select((F.col("ltable_id") * 2).alias("r1"), (F.col("rtable_id") * 2 + 1).alias("r2")).distinct(), "pairs")
    groups = G.components(v, "r1", "r2").select(F.col("v").alias("r1"), F.col("component").alias("entity"))
    return G.without_bridges(v.join(groups, "r1").select("entity", "r1", "r2"), 10)


def entity_link_counts(spark: SparkSession, d: str) -> DataFrame:
    """Links between records of the labelled pairs' groups, by the sides they come from."""
    v = stash(read(spark, d, "valid").where("label = 1 and ltable_id is not null and rtable_id is not null").select((F.col("ltable_id") * 2).alias("a"), (F.col("rtable_id") * 2 + 1).alias("b")).distinct(), "pairs")
    m = G.components(v, "a", "b").select(F.col("v").alias("record"), F.col("component").alias("entity"))
    # Two records of one side make a link, or one of each: the counts of the sides tell how many, without a pair of a hub group being written out.
    sides = m.groupBy("entity").agg(*[F.count(F.when(F.pmod("record", F.lit(2)) == k, 1)).alias(side) for k, side in ((0, "a"), (1, "b"))])
    within = lambda c: F.shiftright(F.col(c) * (F.col(c) - 1), 1)
    links = F.array(*[F.struct(F.lit(link).alias("link"), n.alias("n")) for link, n in (("A-A", within("a")), ("A-B", F.col("a") * F.col("b")), ("B-B", within("b")))])
    return sides.select(F.explode(links).alias("x")).groupBy("x.link").agg(F.sum("x.n").alias("n")).where("n > 0")


def role_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records of the labelled pairs by side: how many a group holds, and how many records are in no match."""
    v = read(spark, d, "valid").where("ltable_id is not null and rtable_id is not null")
    roles = v.select((F.col("ltable_id") * 2).alias("record"), F.lit("A").alias("role")).unionByName(v.select((F.col("rtable_id") * 2 + 1).alias("record"), F.lit("B").alias("role"))).distinct()
    hits = v.where("label = 1").select((F.col("ltable_id") * 2).alias("a"), (F.col("rtable_id") * 2 + 1).alias("b"))
    return V.role_report(G.components(hits, "a", "b").select(F.col("v").alias("record"), F.col("component").alias("entity")), roles)


def link_arities(spark: SparkSession, d: str) -> DataFrame:
    links = F.explode(F.array(*[F.lit(x) for x in CIVIL_LINKS])).alias("link")
    return read(spark, d, "region").where("r_regionkey = 0").select(links).select("link", V.link_arity(F.col("link")).alias("arity"))


QUERIES = {
    "people_types": people_types, "year_trend": year_trend, "linked_age_gaps": linked_age_gaps, "venue_description": venue_description, "feed_counts": feed_counts, "initial_only_authors": initial_only_authors,
    "person_id_parts": person_id_parts, "publication_years": publication_years, "shared_households": shared_households, "link_types": link_types, "linked_attributes": linked_attributes, "agreement_weights": agreement_weights,
    "label_quality": label_quality, "miss_reasons": miss_reasons, "match_components": match_components, "trimmed_orders": trimmed_parts, "sparse_records": sparse_records, "bridged_entities": bridged_entities,
    "entity_link_counts": entity_link_counts, "role_shares": role_shares, "link_arities": link_arities,
}


def _known(f: str, n: int) -> str:
    unknown = {"bpl": "'999'", "stateicp": "'99'"}.get(f)
    return f"CASE WHEN {_code(f'{f}_{n}')} NOT IN ({unknown}) THEN {_code(f'{f}_{n}')} END" if unknown else _code(f"{f}_{n}")


def _std(c: str) -> str:
    from mergekin.plans.basics import _sql_standard

    return _sql_standard(c)


_LINKED = "SELECT DISTINCT * EXCLUDE (loaded_at) FROM couples_csv WHERE linktype <> '9'"
_FS = ["sex", "race", "bpl", "stateicp"]
_AGREE = " UNION ALL ".join(f"SELECT '{f}' AS attr, true AS matched, ({_known(f, 1)}) = ({_known(f, 2)}) AS same FROM l UNION ALL SELECT '{f}', false, x.{f} = y.{f} FROM a x JOIN b y ON x.serial_1 = y.serial_1 AND x.pernum_1 = y.pernum_1 - 1" for f in _FS)
_REACH = """
    e AS (SELECT DISTINCT 2 * ltable_id AS a, 2 * rtable_id + 1 AS b FROM valid WHERE label = 1 AND ltable_id IS NOT NULL AND rtable_id IS NOT NULL),
    arcs AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
    reach(src, v) AS (SELECT DISTINCT u, u FROM arcs UNION SELECT r.src, arcs.v FROM reach r JOIN arcs ON arcs.u = r.v),
    m AS (SELECT v AS record, min(src) AS entity FROM reach GROUP BY v)"""

SQL = {
    "people_types": f"WITH {_CENSUS} SELECT role, sex, count(*) AS n FROM (SELECT coalesce(role, '-') AS role, coalesce(sex, '-') AS sex FROM people) GROUP BY ROLLUP (role, sex)",
    "year_trend": "WITH s AS (SELECT min(year) AS a, max(year) AS b FROM publication_dict WHERE year > 0), y AS (SELECT unnest(range(a, b + 1)) AS y FROM s) SELECT CAST(y AS INTEGER) AS year, (SELECT count(*) FROM publication_dict p WHERE p.year = y) AS n FROM y",
    "linked_age_gaps": "SELECT gap, count(*) AS n FROM (SELECT abs(a - b) AS gap FROM (SELECT DISTINCT couple_id, TRY_CAST(age_1 AS DOUBLE) AS a, TRY_CAST(age_2 AS DOUBLE) AS b FROM couples_csv)) WHERE gap IS NOT NULL GROUP BY gap",
    "venue_description": "SELECT count(venue) AS n, count(*) - count(venue) AS missing, count(DISTINCT venue) AS distinct_values, min(venue) AS least, max(venue) AS most FROM publication_dict",
    "feed_counts": "SELECT feed, count(*) AS n FROM publication_dict GROUP BY feed",
    "initial_only_authors": r"""
        WITH miss AS (SELECT unnest(['', 'unknown', 'n/e', 'no entry', 'nk', 'na', 'ng']) AS m), p AS (SELECT DISTINCT id, source,
            CASE WHEN lower(trim(fname)) NOT IN (SELECT m FROM miss) THEN nullif(trim(regexp_replace(lower(fname), '[^\p{L}\p{N}]+', ' ', 'g')), '') END AS fname,
            CASE WHEN lower(trim(sname)) NOT IN (SELECT m FROM miss) THEN nullif(trim(regexp_replace(lower(sname), '[^\p{L}\p{N}]+', ' ', 'g')), '') END AS sname FROM people_dict)
        SELECT source, count(*) AS n, count(*) FILTER (fname IS NULL) AS no_fname, count(*) FILTER (sname IS NULL) AS no_sname, count(*) FILTER (length(fname) = 1) AS initial_only FROM p GROUP BY source""",
    "person_id_parts": "SELECT CAST(part AS INTEGER) AS part, count(v) AS total, count(DISTINCT v) AS distinct_values FROM (SELECT unnest([0, 1, 2]) AS part, unnest([CAST(year_1 AS VARCHAR), CAST(serial_1 AS VARCHAR), CAST(pernum_1 AS VARCHAR)]) AS v FROM couples_csv) GROUP BY part",
    "publication_years": "SELECT source, min(year) AS first, max(year) AS last, count(*) FILTER (year BETWEEN 1990 AND 1999) AS nineties FROM publication_dict WHERE year > 0 GROUP BY source",
    "shared_households": f"""
        WITH c AS (SELECT serial_1, {_code('relate_1')} AS rel FROM couples_csv), x AS (SELECT DISTINCT serial_1 FROM c WHERE rel IN ('1', '2')), y AS (SELECT DISTINCT serial_1 FROM c WHERE rel = '3')
        SELECT 'couples' AS kind, count(*) AS n FROM x UNION ALL SELECT 'children', count(*) FROM y UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM x UNION SELECT * FROM y)""",
    "link_types": "WITH c AS (SELECT DISTINCT couple_id, serial_1, linktype FROM couples_csv) SELECT linktype, count(*) AS persons, count(DISTINCT serial_1) AS households, round(count(*)::DOUBLE / count(DISTINCT serial_1), 6) AS mean_size, linktype <> '9' AS linked FROM c GROUP BY linktype",
    "linked_attributes": f"""
        WITH l AS ({_LINKED}), v AS (SELECT {_std('namefrst_1')} AS f1, {_std('namefrst_2')} AS f2, {_std('namelast_1')} AS l1, {_std('namelast_2')} AS l2, TRY_CAST(age_1 AS DOUBLE) + 10 AS a1, TRY_CAST(age_2 AS DOUBLE) AS a2 FROM l),
        s AS (SELECT 'namefrst' AS attr, CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL THEN {_edit('f1', 'f2')} END AS sim FROM v UNION ALL SELECT 'namelast', CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN {_edit('l1', 'l2')} END FROM v
              UNION ALL SELECT 'age', CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN {_mad('a1', 'a2')} END FROM v)
        SELECT '1870-1880' AS link, attr, count(*) AS n, count(*) FILTER (sim >= 0.9) AS alike, count(*) FILTER (sim IS NULL) AS missing, round(avg(sim), 6) AS mean FROM s GROUP BY attr""",
    "agreement_weights": f"""
        WITH l AS ({_LINKED}), a AS (SELECT serial_1, pernum_1, {", ".join(f"{_known(f, 1)} AS {f}" for f in _FS)} FROM l), b AS (SELECT serial_1, pernum_1, {", ".join(f"{_known(f, 2)} AS {f}" for f in _FS)} FROM l), s AS ({_AGREE}),
        k AS (SELECT attr, count(*) FILTER (matched AND same)::DOUBLE / count(*) FILTER (matched) AS m, count(*) FILTER (NOT matched AND same)::DOUBLE / nullif(count(*) FILTER (NOT matched), 0) AS u FROM s WHERE same IS NOT NULL GROUP BY attr)
        SELECT attr, round(m, 6) AS m, round(u, 6) AS u, round(CASE WHEN m > 0 AND u > 0 THEN log10(m / u) END, 6) AS w_agree, round(CASE WHEN m < 1 AND u < 1 THEN log10((1 - m) / (1 - u)) END, 6) AS w_disagree FROM k""",
    "link_arities": "SELECT link, CASE " + " ".join(f"WHEN link IN ({', '.join(repr(x) for x in links)}) THEN {n}" for n, links in V.ARITIES.items()) + f" ELSE 1 END AS arity FROM (SELECT unnest([{', '.join(repr(x) for x in CIVIL_LINKS)}]) AS link)",
    "label_quality": f"""
        WITH v AS (SELECT 2 * ltable_id AS a, 2 * rtable_id + 1 AS b, decided_at FROM valid WHERE label = 1 AND ltable_id IS NOT NULL AND rtable_id IS NOT NULL), n AS (SELECT least(a, b) AS a, greatest(a, b) AS b, month(decided_at) AS mo FROM v),
        f AS (SELECT DISTINCT a, b FROM n WHERE mo <= 3), t AS (SELECT DISTINCT a, b FROM n WHERE mo >= 3), c AS (SELECT (SELECT count(*) FROM f JOIN t USING (a, b)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM t) AS nt), d AS (SELECT tp, nf - tp AS fp, nt - tp AS fn FROM c)
        SELECT 'P-P' AS link, {_MEASURES} FROM d""",
    "miss_reasons": f"""
        WITH l AS ({_LINKED}), v AS (SELECT {_std('namefrst_1')} AS f1, {_std('namefrst_2')} AS f2, {_std('namelast_1')} AS l1, {_std('namelast_2')} AS l2 FROM l),
        r AS (SELECT CASE WHEN NOT coalesce(l1 = l2, false) THEN 'no_candidate' WHEN {_edit('f1', 'f2')} < 0.7 THEN 'low_score' ELSE 'constraint' END AS reason FROM v)
        SELECT '1-2' AS link, reason, count(*) AS n FROM r GROUP BY reason""",
    "match_components": f"WITH RECURSIVE {_REACH} SELECT size, count(*) AS entities FROM (SELECT entity, count(*) AS size FROM m GROUP BY entity) GROUP BY size",
    "trimmed_orders": """
        WITH r AS (SELECT o_custkey, o_orderkey, avg(o_totalprice) OVER w AS m, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        b AS (SELECT o_custkey, max(CASE WHEN m >= 200000 THEN k END) AS keep FROM r GROUP BY o_custkey) SELECT o_custkey, o_orderkey FROM r JOIN b USING (o_custkey) WHERE keep >= 2 AND k <= keep""",
    "sparse_records": """
        WITH e AS (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS entity, CAST(c_nationkey AS INTEGER) AS a, -CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS b FROM orders JOIN customer ON o_custkey = c_custkey),
        d AS (SELECT entity, record, count(*) AS degree FROM (SELECT entity, a AS record FROM e UNION ALL SELECT entity, b FROM e) GROUP BY entity, record),
        s AS (SELECT *, count(*) OVER w AS n, sum(degree) OVER w AS ends, min(degree) OVER w AS low FROM d WINDOW w AS (PARTITION BY entity)), t AS (SELECT *, sum(CAST(degree = low AS INTEGER)) OVER (PARTITION BY entity) AS lows FROM s)
        SELECT entity, record FROM t WHERE n >= 4 AND ends::DOUBLE / (n * (n - 1)) <= 0.3 AND degree = low AND lows = 1""",
    "bridged_entities": f"""
        WITH RECURSIVE {_REACH}, n AS (SELECT entity, count(*) AS n FROM m GROUP BY entity), x AS (SELECT n.entity, n.n, e.a, e.b FROM e JOIN m ON m.record = e.a JOIN n USING (entity)),
        w(a, b, v) AS (SELECT a, b, a FROM x WHERE n >= 10 UNION SELECT w.a, w.b, arcs.v FROM w JOIN arcs ON arcs.u = w.v WHERE NOT (arcs.u = w.a AND arcs.v = w.b) AND NOT (arcs.u = w.b AND arcs.v = w.a))
        SELECT entity, a AS r1, b AS r2 FROM x WHERE n < 10 OR EXISTS (SELECT 1 FROM w WHERE w.a = x.a AND w.b = x.b AND w.v = x.b)""",
    "entity_link_counts": f"""
        WITH RECURSIVE {_REACH}, j AS (SELECT a.record AS x, b.record AS y FROM m a JOIN m b USING (entity) WHERE a.record < b.record)
        SELECT CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 'A-A' WHEN x % 2 = 1 AND y % 2 = 1 THEN 'B-B' ELSE 'A-B' END AS link, count(*) AS n FROM j GROUP BY 1""",
    "role_shares": f"""
        WITH RECURSIVE {_REACH}, r AS (SELECT DISTINCT 2 * ltable_id AS record, 'A' AS role FROM valid WHERE ltable_id IS NOT NULL AND rtable_id IS NOT NULL UNION SELECT DISTINCT 2 * rtable_id + 1, 'B' FROM valid WHERE ltable_id IS NOT NULL AND rtable_id IS NOT NULL),
        h AS (SELECT r.role, r.record, m.entity FROM r LEFT JOIN m USING (record)), k AS (SELECT role, min(c) AS least, max(c) AS most, round(avg(c), 6) AS mean FROM (SELECT role, entity, count(*) AS c FROM h WHERE entity IS NOT NULL GROUP BY role, entity) GROUP BY role)
        SELECT h.role, count(*) AS records, count(*) FILTER (entity IS NULL) AS singles, k.least, k.most, k.mean, round(count(*) FILTER (entity IS NULL) * 100.0::DOUBLE / count(*), 2) AS single_share FROM h JOIN k USING (role) GROUP BY h.role, k.least, k.most, k.mean""",
}
