"""Frequency of every distinct value or term.

An external sort: (term, field, record) entries are range-partitioned on all three columns, so
a term that fills a third of the collection spreads over many partitions, and each partition
is sorted, spilling as it needs.  One scan over Arrow batches then run-length counts
occurrences and records; the runs of a term that crosses partitions are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin.session import read
from mergekin.standardise import is_missing, plain, plain_or_null

_RUNS = "field string, term string, occurrences long, records long"


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (field, term) in sorted entries. Rows of one record repeat when it was loaded again: the largest count holds."""
    held: tuple | None = None  # field, term, id and count of the last record so far, its term's occurrences and records before it

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
            names=["field", "term", "occurrences", "records"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        field, term = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        fields, terms = field.dictionary, term.dictionary
        f, t = field.indices.to_numpy(zero_copy_only=False), term.indices.to_numpy(zero_copy_only=False)
        ids, tf = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        new_term = np.r_[True, (t[1:] != t[:-1]) | (f[1:] != f[:-1])]
        new_rec = new_term | np.r_[True, ids[1:] != ids[:-1]]
        starts = np.flatnonzero(new_rec)
        count = np.maximum.reduceat(tf, starts).astype(np.int64)
        term_starts = np.flatnonzero(new_term[starts])
        occ = np.add.reduceat(count, term_starts)
        recs = np.diff(np.r_[term_starts, len(starts)])
        at = starts[term_starts]
        keys = list(zip(fields.take(pa.array(f[at])).to_pylist(), terms.take(pa.array(t[at])).to_pylist(), strict=True))
        runs = [[k[0], k[1], int(o), int(r)] for k, o, r in zip(keys, occ, recs, strict=True)]
        first_id, first_count = int(ids[0]), int(count[0])
        if held is not None:
            if (held[0], held[1]) == keys[0]:
                runs[0][2] += held[4]
                runs[0][3] += held[5]
                if held[2] == first_id:  # the record of the last batch goes on
                    runs[0][2] += max(held[3] - first_count, 0)
                else:
                    runs[0][2] += held[3]
                    runs[0][3] += 1
            else:
                yield out([(held[0], held[1], held[4] + held[3], held[5] + 1)])
        last = runs.pop()
        last_id, last_count = int(ids[-1]), int(count[-1])
        if len(starts) == 1 and held is not None and (held[0], held[1]) == keys[0] and held[2] == first_id:
            last_count = max(held[3], first_count)
        held = (last[0], last[1], last_id, last_count, last[2] - last_count, last[3] - 1)
        if runs:
            yield out([tuple(r) for r in runs])
    if held is not None:
        yield out([(held[0], held[1], held[4] + held[3], held[5] + 1)])


def term_counts(entries: DataFrame) -> DataFrame:
    """(field, term, occurrences, records) from entries (field, term, id, tf).

    tf is how often the term occurs in that row; rows of the same id are deliveries of one record, of
    which the largest tf counts.  Entries with a null term or id are left out; an empty table gives no rows;
    ties and repeats need no order; columns beside these four are ignored.
    """
    entries = entries.select("field", "term", F.col("id").cast("long").alias("id"), F.col("tf").cast("int").alias("tf")).where("field is not null and term is not null and id is not null")
    # Terms first: the sort compares the first bytes of its first column, which as the field would be the same in all rows.
    ordered = entries.repartitionByRange("term", "field", "id").sortWithinPartitions("term", "field", "id")
    runs = ordered.mapInArrow(_count_runs, _RUNS)
    return runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def value_entries(rows: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Entries of a whole-value field: the plain form is the term; missing values are left out."""
    return rows.select(F.lit(column).alias("field"), plain_or_null(column).alias("term"), F.col(id_column).alias("id"), F.lit(1).alias("tf")).where("term is not null")


def word_entries(rows: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Entries of a text field: the words of the plain form, repeats within the row counted before the shuffle."""
    words = F.filter(F.split(plain(column), " "), lambda w: w != "")
    per_word = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("term"), F.size(F.filter("w", lambda y: y == x)).alias("tf")))
    return (
        rows.select(words.alias("w"), F.col(id_column).alias("id"))
        .where("size(w) > 0")
        .select(F.lit(column).alias("field"), F.explode_outer(per_word).alias("e"), "id")  # outer, as else the optimizer forms the array once more to see that it has entries
        .select("field", "e.term", "id", "e.tf")
    )


def records_with_terms(rows: DataFrame, columns: dict[str, bool], id_column: str = "id") -> DataFrame:
    """(field, of_records): distinct ids that have a term in each column, told without forming the terms; whole-value fields (True) pass over missing texts."""
    has = {c: F.coalesce(F.col(c).rlike(r"[\p{L}\p{N}]"), F.lit(False)) & (~is_missing(c) if whole else F.lit(True)) for c, whole in columns.items()}
    per_id = rows.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column)).agg(*[F.max(h).alias(f"_{i}") for i, h in enumerate(has.values())])
    sums = per_id.agg(*[F.count_if(F.col(f"_{i}")).alias(f"_{i}") for i in range(len(has))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{i}").alias("of_records")) for i, c in enumerate(has)])).alias("x")).select("x.*")


def marked_terms(entries: DataFrame, common_share: float = 0.03, rare_occurrences: int = 1, totals: DataFrame | None = None) -> DataFrame:
    """(field, term, occurrences, records, of_records, mark): mark is 'rare', 'common' or null.

    of_records is the number of distinct ids with at least one term in the field (totals, if the caller knows them cheaper than by
    counting the entries); a field of one record with one term is rare first.
    """
    counts = term_counts(entries)
    if totals is None:
        totals = entries.where("term is not null and id is not null").select("field", "id").distinct().groupBy("field").agg(F.count("*").alias("of_records"))
    mark = F.when(F.col("occurrences") <= rare_occurrences, "rare").when(F.col("records") > common_share * F.col("of_records"), "common")
    return counts.join(F.broadcast(totals), "field").withColumn("mark", mark)  # totals: one row per field


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = read(spark, sf_dir, "people_dict").select("id", "fname", "sname")
    pubs = read(spark, sf_dir, "publication_dict").select("id", "pub_name")
    entries = value_entries(people, "fname").unionByName(value_entries(people, "sname")).unionByName(word_entries(pubs, "pub_name"))
    totals = records_with_terms(people, {"fname": True, "sname": True}).unionByName(records_with_terms(pubs, {"pub_name": False}))
    return marked_terms(entries, totals=totals)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("field", "term", "occurrences", "records", "mark")


_SQL = r"""
    WITH miss AS (SELECT unnest(['', 'unknown', 'n/e', 'no entry', 'nk', 'na', 'ng']) AS m),
    p AS (SELECT DISTINCT id, fname, sname FROM people_dict),
    t AS (
        SELECT 'fname' AS field, id, trim(regexp_replace(lower(fname), '[^\p{L}\p{N}]+', ' ', 'g')) AS term FROM p
        WHERE fname IS NOT NULL AND lower(trim(fname)) NOT IN (SELECT m FROM miss)
        UNION ALL
        SELECT 'sname', id, trim(regexp_replace(lower(sname), '[^\p{L}\p{N}]+', ' ', 'g')) FROM p
        WHERE sname IS NOT NULL AND lower(trim(sname)) NOT IN (SELECT m FROM miss)
        UNION ALL
        SELECT 'pub_name', id, unnest(string_split(trim(regexp_replace(lower(pub_name), '[^\p{L}\p{N}]+', ' ', 'g')), ' '))
        FROM (SELECT DISTINCT id, pub_name FROM publication_dict WHERE pub_name IS NOT NULL)),
    ok AS (SELECT * FROM t WHERE term <> ''),
    n AS (SELECT field, count(DISTINCT id) AS of_records FROM ok GROUP BY field),
    c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM ok GROUP BY field, term),
    marked AS (
        SELECT field, term, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records,
               CASE WHEN occurrences = 1 THEN 'rare' WHEN records > 0.03 * of_records THEN 'common' END AS mark
        FROM c JOIN n USING (field))
"""
SQL = {
    "p4_found": _SQL + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_counts": _SQL + "SELECT field, term, occurrences, records, mark FROM marked",
}
QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
