from datetime import datetime

from mergekin.plans import reports


def test_link_counts_keep_large_groups(spark, tmp_path):
    star = [(0, i) for i in range(15)] + [(7, 100)]  # a hub of 16 records, and a pair
    spark.createDataFrame([(a, b, 1, datetime(2022, 1, 1)) for a, b in star], "ltable_id long, rtable_id long, label int, decided_at timestamp").write.parquet(str(tmp_path / "valid.parquet"))
    got = {r.link: r.n for r in reports.entity_link_counts(spark, str(tmp_path)).collect()}
    assert got == {"A-B": 16, "B-B": 105}
