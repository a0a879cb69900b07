"""Queries of the readers, the civil pipeline and incremental arrival, on the driver's tables cast into their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin import standardise as S
from mergekin.functions.columns import encode_udf
from mergekin.functions.maths import WordOrders
from mergekin.operators import civil, graphs
from mergekin.plans.basics import _code, _sql_standard
from mergekin.plans.linkage import sql_one_to_one
from mergekin.session import read, stash
from mergekin.sources import registers, sinks, tables
from mergekin.streaming.arrivals import latest_deliveries


def _raw_publications(spark: SparkSession, d: str) -> DataFrame:
    """Publication rows as a raw file has them: one text of all authors."""
    people = read(spark, d, "people_dict").where("fullname is not null").select("pub_id", "author_no", F.regexp_replace("fullname", ",", "").alias("fullname")).distinct()
    names = people.groupBy("pub_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("author_no", "fullname"))), lambda x: x.fullname), ", ").alias("authors"))
    pubs = read(spark, d, "publication_dict").dropDuplicates(["id"])
    return pubs.join(names, pubs["id"] == names["pub_id"]).select(pubs["id"].cast("string").alias("id"), F.col("pub_name").alias("title"), "authors", "venue", F.col("year").cast("string").alias("year"))


def bibliographic_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors split out of publication rows, with their co-authors."""
    return tables.authors(_raw_publications(spark, d)).select("id", "pub_id", "author_no", "year", "fullname", "sname", F.size("coauthor_ids").alias("coauthors"))


def parsed_publications(spark: SparkSession, d: str) -> DataFrame:
    return tables.publications(_raw_publications(spark, d)).select("id", "role", "year", "venue", "pub_name")


def decoded_census(spark: SparkSession, d: str) -> DataFrame:
    """Census rows with the labels of their birthplace and occupation codes."""
    c = read(spark, d, "couples_csv").select("couple_id", S.census_code("bpl_1", "bpl").alias("bpl"), S.census_code("occ1950_1", "occ1950").alias("occ")).distinct()
    c = tables.decoded(c, "bpl", read(spark, d, "bpl_codes"), "birth_place")
    return tables.decoded(c, "occ", read(spark, d, "occ_codes"), "occupation").select("couple_id", "birth_place", "occupation")


def song_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as songs of two sources."""
    p = read(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "10").otherwise("20"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("album"), F.col("p_type").alias("artist"), (F.col("p_size") + 1950).cast("string").alias("year"), F.concat_ws(":", F.col("p_size").cast("string"), F.lit("05")).alias("length"))
    return tables.songs(p.where("id like '10%'"), p.where("id like '20%'"))


def matched_songs(spark: SparkSession, d: str) -> DataFrame:
    """Songs of the two sources with the same title and artist and years within two, one to one by year and length."""
    s = song_records(spark, d)
    x, y = (s.where(F.col("source") == k).select(*[F.col(c).alias(f"{c}_{k}") for c in ("id", "year", "length")], "title", "artist") for k in ("A", "B"))
    near = x.join(y, ["title", "artist"]).where("abs(year_A - year_B) <= 2")
    score = 1 - F.abs(F.col("year_A") - F.col("year_B")) / 10 - F.abs(F.col("length_A") - F.col("length_B")) / 100000
    return graphs.one_to_one(near.select(F.col("id_A").alias("r1"), F.col("id_B").alias("r2"), score.alias("sim"))).select("r1", "r2")


def _certificates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Households as certificates: a birth for every child (with its parents) of the first census, and a marriage for every couple of the second."""
    c = read(spark, d, "couples_csv").dropDuplicates(["couple_id"])

    def members(n: int, relate: str, sex: str | None, prefix: str) -> DataFrame:
        rows = c.where((S.census_text(f"relate_{n}").isin(relate.split())) & (F.lit(True) if sex is None else S.census_text(f"sex_{n}") == sex))
        named = [F.col(f"namefrst_{n}").alias(f"{prefix}_fname"), F.col(f"namelast_{n}").alias(f"{prefix}_sname"), S.census_text(f"age_{n}").alias(f"{prefix}_age"), F.when(S.census_text(f"sex_{n}") == "1", "m").otherwise("f").alias(f"{prefix}_gender")]
        return rows.select(F.col(f"serial_{n}").alias("serial"), F.col(f"pernum_{n}").alias("p"), F.col("couple_id").alias("c"), *named)

    def parent(n: int, relate: str, sex: str, prefix: str) -> DataFrame:
        """One of a household: the first listed."""
        m = members(n, relate, sex, prefix)
        kept = [x for x in m.columns if x.startswith(prefix)]
        return m.groupBy("serial").agg(F.min_by(F.struct(*kept), F.struct("p", "c")).alias("m")).select("serial", "m.*")

    births = members(1, "3", None, "child").join(parent(1, "1 2", "2", "mother"), "serial", "left").join(parent(1, "1 2", "1", "father"), "serial", "left")
    born = F.concat(F.lit("1/6/"), (1870 - F.coalesce(F.col("child_age").try_cast("int"), F.lit(0))).cast("string"))
    births = births.select(F.concat(F.lit("b"), F.col("c").cast("string")).alias("cert_id"), born.alias("event_date"), *[x for x in births.columns if x not in ("serial", "p", "c")])
    weddings = parent(2, "1 2", "2", "bride").join(parent(2, "1 2", "1", "groom"), "serial")
    weddings = weddings.select(F.concat(F.lit("m"), F.col("serial").cast("string")).alias("cert_id"), F.lit("1/6/1880").alias("event_date"), *[x for x in weddings.columns if x != "serial"])
    return births, weddings


def _people(spark: SparkSession, d: str) -> DataFrame:
    births, weddings = _certificates(spark, d)
    return registers.certificate_people(births, "birth").unionByName(registers.certificate_people(weddings, "marriage"))


def certificate_people(spark: SparkSession, d: str) -> DataFrame:
    """People on certificates by role and sex: how many, with which relations known."""
    p = _people(spark, d)
    return p.groupBy("kind", "role", "sex").agg(F.count("*").alias("n"), *[F.count(r).alias(r) for r in ("mother", "father", "child", "spouse")])


def civil_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Candidate nodes of the civil pipeline: people of one surname and given name, gated by role, with their relatives' pairs."""
    p = stash(_people(spark, d), "people")
    named = p.where("fname is not null and sname is not null").select("id", "sname", "fname")
    pairs = named.withColumnRenamed("id", "r1").join(named.withColumnRenamed("id", "r2"), ["sname", "fname"]).where("r1 < r2").select("r1", "r2")
    return civil.civil_candidates(p, pairs)


def civil_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between candidate nodes whose people are relatives on both certificates."""
    p = stash(_people(spark, d), "people")
    nodes = stash(civil_nodes(spark, d).select("r1", "r2").withColumn("node", F.concat_ws("|", "r1", "r2")), "nodes")
    return civil.certificate_edges(nodes.select("node", "r1", "r2"), registers.relatives(p))


def compatible_entities(spark: SparkSession, d: str) -> DataFrame:
    """Which pairs of one-record entities the civil constraints let merge, by link."""
    p = stash(_people(spark, d), "people")
    nodes = civil_nodes(spark, d)
    ents = civil.entities_of(p.select(F.col("id").alias("record"), F.col("id").alias("entity")), p)
    one = ents.select("entity", F.struct(*[c for c in ents.columns if c != "entity"]).alias("e"))
    both = nodes.join(one.select(F.col("entity").alias("r1"), F.col("e").alias("x")), "r1").join(one.select(F.col("entity").alias("r2"), F.col("e").alias("y")), "r2")
    return both.groupBy("link").agg(F.count("*").alias("n"), F.count(F.when(civil.entities_compatible("x", "y"), 1)).alias("compatible"))


def corrected_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of every publication record by each channel."""
    p = read(spark, d, "publication_dict").select("id", "source", "origin_id", "feed", "loaded_at", "year")
    return latest_deliveries(p, ["source", "origin_id", "feed"], "loaded_at").select("source", "origin_id", "feed", "id", "year")


def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    """Entities as JSON with the sets of their records' values."""
    p = read(spark, d, "people_dict").where("entity_id is not null").select(F.col("id"), "entity_id", S.standard_string("fname").alias("fname"), S.standard_string("sname").alias("sname")).distinct()
    return sinks.entities_json(p.select(F.col("id").alias("record"), F.col("entity_id").alias("entity")), p.select("id", "fname", "sname"), ["fname", "sname"])


def word_orders(spark: SparkSession, d: str) -> DataFrame:
    """All word orders of the nations' and regions' names."""
    spark.udtf.register("word_orders", WordOrders)
    n = read(spark, d, "region").select(F.concat_ws(" ", F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("of"), F.lit("earth")).alias("name"))
    n.createOrReplaceTempView("mergekin_names")
    return spark.sql("SELECT name, o.ordering FROM mergekin_names, LATERAL word_orders(name) o")


def surname_codes(spark: SparkSession, d: str) -> DataFrame:
    """Persons per blocking key of their surname: the sizes of the blocks."""
    p = read(spark, d, "people_dict").select("id", S.standard_string("sname").alias("sname")).distinct()
    codes = p.select("sname").where("sname is not null").distinct().withColumn("code", encode_udf("dmetaphone4")("sname"))
    return p.join(codes, "sname").groupBy("code").agg(F.count("*").alias("records"), F.count_distinct("sname").alias("names"))


QUERIES = {
    "bibliographic_authors": bibliographic_authors, "parsed_publications": parsed_publications, "decoded_census": decoded_census, "song_records": song_records, "matched_songs": matched_songs,
    "certificate_people": certificate_people, "civil_nodes": civil_nodes, "civil_edges": civil_edges, "compatible_entities": compatible_entities, "corrected_deliveries": corrected_deliveries,
    "entity_documents": entity_documents, "word_orders": word_orders, "surname_codes": surname_codes,
}

_PUNCT = r"[!-/:-@\[-`{-~]"


def _sql_parent(n: int, sex: str, name: str) -> str:
    """The first listed adult of that sex of each household: names and whether there is one."""
    return f"""{name} AS (SELECT serial_{n} AS serial, arg_min({_sql_standard(f'namefrst_{n}')}, (pernum_{n}, couple_id)) AS a_f, arg_min({{'f': {_sql_standard(f'namefrst_{n}')}, 's': {_sql_standard(f'namelast_{n}')}}}, (pernum_{n}, couple_id)) AS v
        FROM c WHERE {_code(f'relate_{n}')} IN ('1', '2') AND {_code(f'sex_{n}')} = '{sex}' GROUP BY serial_{n})"""


_SET = "coalesce(to_json(list_sort(list(DISTINCT {0}) FILTER ({0} IS NOT NULL)))::VARCHAR, '[]')"
SQL = {
    "entity_documents": f"""
        WITH p AS (SELECT DISTINCT id, entity_id, {_sql_standard('fname')} AS fname, {_sql_standard('sname')} AS sname FROM people_dict WHERE entity_id IS NOT NULL)
        SELECT entity_id AS entity, '{{"size":' || count(*) || ',"fname":' || {_SET.format('fname')} || ',"sname":' || {_SET.format('sname')} || '}}' AS json FROM p GROUP BY entity_id""",
    "certificate_people": f"""
        WITH c AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM couples_csv), {_sql_parent(1, '2', 'mo')}, {_sql_parent(1, '1', 'fa')}, {_sql_parent(2, '2', 'br')}, {_sql_parent(2, '1', 'gr')},
        b AS (SELECT CASE WHEN {_code('sex_1')} = '1' THEN 'M' ELSE 'F' END AS sex, coalesce({_sql_standard('namefrst_1')}, {_sql_standard('namelast_1')}) IS NOT NULL AS child,
                     coalesce(mo.v.f, mo.v.s) IS NOT NULL AS mother, coalesce(fa.v.f, fa.v.s) IS NOT NULL AS father FROM c LEFT JOIN mo ON mo.serial = serial_1 LEFT JOIN fa ON fa.serial = serial_1 WHERE {_code('relate_1')} = '3'),
        w AS (SELECT coalesce(br.v.f, br.v.s) IS NOT NULL AS bride, coalesce(gr.v.f, gr.v.s) IS NOT NULL AS groom FROM br JOIN gr USING (serial)),
        p AS (SELECT 'birth' AS kind, 'Bb' AS role, sex, mother, father, false AS child, false AS spouse FROM b WHERE child UNION ALL SELECT 'birth', 'Bp', 'F', false, false, child, father FROM b WHERE mother
              UNION ALL SELECT 'birth', 'Bp', 'M', false, false, child, mother FROM b WHERE father UNION ALL SELECT 'marriage', 'Mm', 'F', false, false, false, groom FROM w WHERE bride
              UNION ALL SELECT 'marriage', 'Mm', 'M', false, false, false, bride FROM w WHERE groom)
        SELECT kind, role, sex, count(*) AS n, count(*) FILTER (mother) AS mother, count(*) FILTER (father) AS father, count(*) FILTER (child) AS child, count(*) FILTER (spouse) AS spouse FROM p GROUP BY kind, role, sex""",
    "matched_songs": f"""
        WITH RECURSIVE s AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN '10' ELSE '20' END || CAST(p_partkey AS VARCHAR) AS id, p_partkey % 2 AS side, {_sql_standard('p_name')} AS title, {_sql_standard('p_type')} AS artist, p_size + 1950 AS year, p_size * 60 + 5 AS length FROM part),
        pairs AS (SELECT x.id AS l, y.id AS r, 1 - abs(x.year - y.year) / 10.0::DOUBLE - abs(x.length - y.length) / 100000.0::DOUBLE AS s FROM s x JOIN s y ON x.side = 0 AND y.side = 1 AND x.title = y.title AND x.artist = y.artist AND abs(x.year - y.year) <= 2),
        {sql_one_to_one('pairs')} SELECT l AS r1, r AS r2 FROM g WHERE ok""",
    "bibliographic_authors": rf"""
        WITH n AS (SELECT DISTINCT pub_id, author_no, replace(fullname, ',', '') AS fullname FROM people_dict WHERE fullname IS NOT NULL),
        a AS (SELECT pub_id, string_agg(fullname, ', ' ORDER BY author_no, fullname) AS authors FROM n GROUP BY pub_id), p AS (SELECT DISTINCT id, year FROM publication_dict),
        l AS (SELECT id, year, list_filter(list_transform(string_split(regexp_replace(authors, '\s*&.*;\s*', ' '), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM p JOIN a ON a.pub_id = p.id),
        e AS (SELECT id AS pub, year, len(l) AS k, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS fullname FROM l),
        w AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(fullname, '{_PUNCT}', ' ', 'g')), '\s+'), lambda x: x <> '') AS w FROM e)
        SELECT CAST(pub AS VARCHAR) || '_' || CAST(pos AS VARCHAR) AS id, CAST(pub AS VARCHAR) AS pub_id, CAST(pos AS INTEGER) AS author_no, CAST(year AS BIGINT) AS year, fullname,
               CASE WHEN len(w) = 1 THEN w[1] WHEN len(w) = 2 THEN w[2] ELSE w[3] END AS sname, CAST(k - 1 AS INTEGER) AS coauthors FROM w""",
    "parsed_publications": f"SELECT DISTINCT CAST(id AS VARCHAR) AS id, 'P' AS role, CAST(year AS BIGINT) AS year, {_sql_standard('venue')} AS venue, {_sql_standard('pub_name')} AS pub_name FROM publication_dict WHERE id IN (SELECT pub_id FROM people_dict WHERE fullname IS NOT NULL)",
    "decoded_census": f"""
        WITH c AS (SELECT DISTINCT couple_id, CASE WHEN {_code('bpl_1')} <> '999' THEN {_code('bpl_1')} END AS bpl, CASE WHEN {_code('occ1950_1')} NOT IN ('995', '997', '999') THEN {_code('occ1950_1')} END AS occ FROM couples_csv)
        SELECT couple_id, b.label AS birth_place, o.label AS occupation FROM c LEFT JOIN bpl_codes b ON b.code = c.bpl LEFT JOIN occ_codes o ON o.code = c.occ""",
    "song_records": f"""
        SELECT CASE WHEN p_partkey % 2 = 0 THEN '10' ELSE '20' END || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS source, {_sql_standard('p_name')} AS title, {_sql_standard('p_brand')} AS album,
               {_sql_standard('p_type')} AS artist, CAST(p_size + 1950 AS BIGINT) AS year, CAST(p_size * 60 + 5 AS BIGINT) AS length FROM part""",
    "corrected_deliveries": """
        WITH r AS (SELECT source, origin_id, feed, id, year, row_number() OVER (PARTITION BY source, origin_id, feed ORDER BY loaded_at DESC, id DESC) AS k FROM publication_dict) SELECT source, origin_id, feed, id, year FROM r WHERE k = 1""",
    "word_orders": "WITH n AS (SELECT replace(r_name, ' ', '_') || ' of earth' AS name, [replace(r_name, ' ', '_'), 'of', 'earth'] AS w FROM region) SELECT name, w[i] || ' ' || w[j] || ' ' || w[6 - i - j] AS ordering FROM n, (SELECT unnest([1, 2, 3]) AS i) a, (SELECT unnest([1, 2, 3]) AS j) b WHERE i <> j",
}
