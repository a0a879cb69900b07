import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mergekin.llm import p4_terms as T


def test_counts_against_brute_force_with_a_hot_term_and_small_batches(spark):
    rng = random.Random(1)
    rows = [("f", "hot" if rng.random() < 0.4 else f"t{rng.randrange(60)}", rng.randrange(300), rng.randint(1, 3)) for _ in range(3000)]
    seen: dict = {}
    for f, t, i, n in rows:
        seen[f, t, i] = max(n, seen.get((f, t, i), 0))
    want: dict = defaultdict(lambda: [0, 0])
    for (f, t, _), n in seen.items():
        want[f, t][0] += n
        want[f, t][1] += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    df = spark.createDataFrame([(*r, "z") for r in rows], "field string, term string, id long, tf int, records string")
    got = {(r.field, r.term): [r.occurrences, r.records] for r in T.term_counts(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == dict(want)


def test_words_nulls_repeats_and_long_texts(spark):
    long_text = "same " * 50_000
    rows = [(1, "A b a", 9), (1, "A b a", 9), (2, None, 9), (3, "", 9), (4, " ?! ", 9), (5, long_text, 9), (None, "a", 9)]
    df = spark.createDataFrame(rows, "id long, title string, term int")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in T.marked_terms(T.word_entries(df, "title"), 0.9).collect()}
    assert got == {"a": (2, 1, None), "b": (1, 1, "rare"), "same": (50_000, 1, None)}
    assert T.marked_terms(T.word_entries(df.limit(0), "title")).count() == 0


def test_whole_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["Ann-Mary", "ann mary", "n/e", "", None, "Éva"])], "id long, name string")
    counts = Counter({r.term: r.occurrences for r in T.term_counts(T.value_entries(df, "name")).collect()})
    assert counts == {"ann mary": 2, "éva": 1}
    assert T.value_entries(df, "name").where(F.col("term").isNull()).count() == 0


def test_records_are_counted_alike_with_and_without_the_entries(spark):
    rows = spark.createDataFrame([(1, "Ann", "a b"), (1, "Ann", "a b"), (2, "n/e", "n/e"), (3, None, "--"), (4, "...", None), (5, "É", " "), (None, "x", "y")], "id long, v string, t string")
    entries = T.value_entries(rows, "v").unionByName(T.word_entries(rows, "t"))
    given = T.records_with_terms(rows, {"v": True, "t": False})
    assert sorted(map(tuple, T.marked_terms(entries).collect()), key=str) == sorted(map(tuple, T.marked_terms(entries, totals=given).collect()), key=str)
