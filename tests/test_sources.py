import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergekin.operators import civil
from mergekin.sources import registers, sinks, tables
from mergekin.streaming.arrivals import latest_deliveries, snapshot, upsert_stream

XML = """<root xmlns:a2a="x"><a2a:A2A>
<a2a:Person pid="p1"><a2a:PersonName><a2a:PersonNameFirstName>Jan</a2a:PersonNameFirstName><a2a:PersonNameLastName>Smit</a2a:PersonNameLastName></a2a:PersonName><a2a:Gender>Man</a2a:Gender></a2a:Person>
<a2a:Person pid="p2"><a2a:PersonName><a2a:PersonNameFirstName>Griet, Anna</a2a:PersonNameFirstName></a2a:PersonName><a2a:Gender>Vrouw</a2a:Gender></a2a:Person>
<a2a:Event eid="e1"><a2a:EventDate><a2a:Year>1880</a2a:Year><a2a:Month>4</a2a:Month><a2a:Day>3</a2a:Day></a2a:EventDate><a2a:EventPlace><a2a:Place>Tilburg</a2a:Place></a2a:EventPlace></a2a:Event>
<a2a:RelationEP><a2a:PersonKeyRef>p1</a2a:PersonKeyRef><a2a:RelationType>Kind</a2a:RelationType></a2a:RelationEP>
<a2a:RelationEP><a2a:PersonKeyRef>p2</a2a:PersonKeyRef><a2a:RelationType>Moeder</a2a:RelationType></a2a:RelationEP>
</a2a:A2A></root>"""


def test_csv_songs_and_authors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,authors,venue,year\n1,"One, two","Ann B Lee, Bo Orr",V,1990\n1,Again,"Ann Lee &nbsp; ",V,1991\n2,,,,\n')
    rows = tables.keyed_csv(spark, str(tmp_path / "a.csv"), "id", ["id", "title", "authors", "venue", "year"])
    assert {(r.id, r.title) for r in rows.collect()} == {("1", "Again"), ("2", None)}
    raw = spark.createDataFrame([("7", "T!", "Ann B Lee, Bo Orr, Cher", "V", "1990"), ("8", None, None, None, None)], "id string, title string, authors string, venue string, year string")
    got = {r.id: r for r in tables.authors(raw).collect()}
    assert got["7_1"].mname == "b" and got["7_1"].sname == "lee" and got["7_1"].coauthor_ids == ["7_2", "7_3"] and got["7_3"].fname == got["7_3"].sname == "cher"
    a = spark.createDataFrame([("101", "Song", "X", "Y", "1990", "3:05")], "id string, title string, album string, artist string, year string, length string")
    s = tables.songs(a, a.withColumn("id", F.lit("202"))).collect()
    assert [(r.source, r.length) for r in s] == [("A", 185), ("B", 185)]


def test_geocodes_books_stata_json(spark, tmp_path):
    g = tables.geocodes(spark.createDataFrame([("x", "[55.8, -4.25]"), ("y", "none")], "location string, geocode string")).collect()
    assert (g[0].lat, g[0].lon) == (55.8, -4.25) and g[1].lat is None
    (tmp_path / "b.csv").write_text("1,weaver\n2,miner\n")
    book = tables.code_book(spark, str(tmp_path / "b.csv"))
    df = spark.createDataFrame([("1",), ("9",), (None,)], "occ string")
    assert {(r.occ, r.job) for r in tables.decoded(df, "occ", book, "job").collect()} == {("1", "weaver"), ("9", None), (None, None)}
    pd.DataFrame({"age": [3, 4], "name": ["a", "b"]}).to_stata(tmp_path / "c.dta", write_index=False)
    assert tables.read_stata(spark, str(tmp_path / "c.dta")).count() == 2
    (tmp_path / "p.json").write_text('{"id": "1", "fname": "x"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("fname", T.StringType())])
    assert tables.people_json(spark, str(tmp_path / "p.json"), schema).first().fname == "x"


def test_archive_xml_to_civil_people(spark, tmp_path):
    (tmp_path / "r.xml").write_text(XML)
    records = registers.read_archive_xml(spark, str(tmp_path / "r.xml"))
    assert "a2a:Person._pid" in registers.xml_tags(records)
    rows = registers.archive_certificates(records, "birth", 1800, 1900)
    r = rows.first()
    assert (r.cert_id, r.event_date, r.child_fname, r.child_gender, r.mother_fname, r.father_fname) == ("e1", "3/4/1880", "Jan", "m", "Griet, Anna", None)
    assert registers.archive_certificates(records, "birth", 1900, 1950).count() == 0
    people = {p.id: p for p in registers.certificate_people(rows, "birth").collect()}
    assert set(people) == {"e1_child", "e1_mother"}
    assert people["e1_child"].role == "Bb" and people["e1_child"].mother == "e1_mother" and people["e1_child"].father is None and people["e1_child"].birth_year == 1880
    assert people["e1_mother"].sex == "F" and people["e1_mother"].child == "e1_child"


def test_civil_candidates_and_edges(spark):
    births = spark.createDataFrame([("b1", "1/6/1850", "Ann", "Lee", "f", "Mary", "Lee", "Bo", "Lee")], "cert_id string, event_date string, child_fname string, child_sname string, child_gender string, mother_fname string, mother_sname string, father_fname string, father_sname string")
    deaths = spark.createDataFrame([("d1", "1/6/1852", "Ann", "Lee", "f", "Mary", "Lee", "Bo", "Lee", "2")], "cert_id string, event_date string, deceased_fname string, deceased_sname string, deceased_gender string, mother_fname string, mother_sname string, father_fname string, father_sname string, deceased_age string")
    people = registers.certificate_people(births, "birth").unionByName(registers.certificate_people(deaths, "death"))
    pairs = spark.createDataFrame([("b1_child", "d1_deceased"), ("b1_mother", "d1_deceased")], "r1 string, r2 string")
    nodes = civil.civil_candidates(people, pairs)
    got = {(r.r1, r.r2): (r.link, r.origin) for r in nodes.collect()}
    assert got[("b1_child", "d1_deceased")] == ("Bb-Dd", "self")
    assert got[("b1_mother", "d1_mother")][0] == "Bp-Dp" and got[("b1_father", "d1_father")][0] == "Bp-Dp"
    named = nodes.select("r1", "r2").withColumn("node", F.concat_ws("|", "r1", "r2"))
    edges = {(r.src, r.dst, r.strength) for r in civil.certificate_edges(named, registers.relatives(people)).collect()}
    assert ("b1_child|d1_deceased", "b1_mother|d1_mother", "BS") in edges


def test_sinks(spark, tmp_path):
    sinks.write_graph(str(tmp_path / "g"), nodes=spark.range(3), edges=spark.range(2))
    assert sinks.read_graph(spark, str(tmp_path / "g"), "nodes")["nodes"].count() == 3
    q = spark.createDataFrame([("P-P", 100, 5, 10, 95.24, 90.91, 86.96), ("X", 1, 1, 1, 50.0, 50.0, 33.3)], "link string, tp long, fp long, fn long, precision double, recall double, f_star double")
    rows = sinks.result_rows(q, 0.8, 0.9, "def", "s", 1.5)
    assert rows.columns == sinks.RESULT_COLUMNS and rows.count() == 1
    for _ in range(2):
        sinks.append_results(rows, str(tmp_path / "res"))
    assert spark.read.option("header", True).csv(str(tmp_path / "res")).count() == 2


def test_arrivals(spark, tmp_path):
    schema = "id long, k string, at long"
    spark.createDataFrame([(1, "a", 1), (2, "a", 3), (3, "b", 1)], schema).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    go = lambda: upsert_stream(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert go()
    spark.createDataFrame([(4, "a", 2), (5, "b", 9)], schema).write.parquet(str(tmp_path / "in"), mode="append")
    assert go()
    got = {(r.k, r.id) for r in snapshot(spark, str(tmp_path / "out"), 99).collect()}
    assert got == {("a", 2), ("b", 5)}
    assert latest_deliveries(spark.createDataFrame([], schema), ["k"], "at").count() == 0
