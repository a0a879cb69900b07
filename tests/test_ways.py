from pyspark.sql import functions as F

from mergekin.operators import graphs as G
from mergekin.plans import bibliography as B


def test_ways_link_the_sure_groups_once(spark, monkeypatch):
    none = F.lit(None).cast("long")
    rows = [(g, r1, r2, k, s) for g in range(12) for r1, r2, k, s in ((g, 100 + g, "P-P", 0.99 - 0.01 * (g % 5)), (1000 + g, 2000 + g, "A-A", 1.0), (g // 2, 100 + g, "P-P", 0.93))[: 2 + g % 2]]
    n = spark.createDataFrame(rows, "group_id long, r1 long, r2 long, link string, sim double").withColumns({"year1": none, "year2": none})
    runs, linked = [], G.greedy_groups
    monkeypatch.setattr(G, "greedy_groups", lambda nodes, t, *more: runs.append(t) or linked(nodes, t, *more))
    monkeypatch.setattr(B, "nodes", lambda *_: n)
    got = {tuple(x) for x in B.resolved_by_reason(spark, "").collect()}
    assert runs.count(B.BOOTSTRAP_T) == 2  # of the groups, and of single nodes, which has none
    total = {x.link: x["count"] for x in n.groupBy("link").count().collect()}
    want = {(way, x.link, x.reason, x["count"], total[x.link]) for way, how in (("whole", {}), ("no relations", {"relations": False}), ("no propagation", {"propagate": False})) for x in B.resolved(n, **how).groupBy("link", "reason").count().collect()}
    assert got == want and {x[2] for x in got} == {"sure group", "group"}
