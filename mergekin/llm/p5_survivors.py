"""Best representative of each duplicate group.

A latent two-sided quality model.  Each value a group's deliveries give for a field is a fact
that is true or false; each delivery asserts one value and thereby denies the others.  A source has a
sensitivity (asserts what is true) and a specificity (stays off what is false); both, and the prior of a fact
by how well its value is known in the whole collection, are inferred by expectation-maximisation.
Facts with the same observations have the same posterior, so the iterations run over the distinct
observation patterns and only the parameters (one row per field and source) come to the driver.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin.session import read, stash
from mergekin.standardise import plain_or_null

#: Facts whose posterior is at least this are judged true.
TRUE_AT = 0.5


def _claims(rows: DataFrame, group: str, fields: dict[str, Column], source: str, when: str) -> DataFrame:
    """(g, field, value, source, at): one row per delivery and field that has a value."""
    named = [F.struct(F.lit(name).alias("field"), value.cast("string").alias("value")) for name, value in fields.items()]
    return (
        rows.where(F.col(group).isNotNull())
        .select(F.col(group).alias("g"), F.coalesce(F.col(source), F.lit("?")).alias("source"), F.col(when).alias("at"), F.explode(F.array(*named)).alias("c"))
        .select("g", "c.field", "c.value", "source", "at")
        .where("value is not null")
    )


def _facts(claims: DataFrame, standing: DataFrame | None) -> DataFrame:
    """(g, field, value, bucket, pattern): pattern is the sorted list of (source class, assertions, denials).

    A source's latest delivery of a group is a class of its own ('source+'), earlier ones, which it corrects, another ('source-').
    """
    counts = claims.groupBy("g", "field", "source", "value", "at").agg(F.count("*").alias("n"))
    latest = counts.groupBy("g", "field", "source").agg(F.max("at").alias("last"))
    counts = counts.join(latest, ["g", "field", "source"])
    cls = F.concat("source", F.when(F.col("at") == F.col("last"), "+").otherwise("-"))
    counts = counts.groupBy("g", "field", "value", cls.alias("cls")).agg(F.sum("n").alias("pos"))
    totals = counts.groupBy("g", "field", "cls").agg(F.sum("pos").alias("total"))
    values = counts.select("g", "field", "value").distinct()
    seen = values.join(totals, ["g", "field"]).join(counts, ["g", "field", "value", "cls"], "left")
    seen = seen.withColumn("pos", F.coalesce("pos", F.lit(0)))
    pattern = F.array_sort(F.collect_list(F.struct("cls", "pos", (F.col("total") - F.col("pos")).alias("neg"))))
    facts = seen.groupBy("g", "field", "value").agg(pattern.alias("pattern"))
    if standing is None:
        return facts.withColumns({"known": F.lit(0.0), "bucket": F.lit(0)})
    facts = facts.join(standing, ["field", "value"], "left").withColumn("known", F.coalesce("known", F.lit(0.0)))
    best = facts.groupBy("g", "field").agg(F.max("known").alias("best"))
    gap = F.greatest(F.lit(-9), F.ceil(F.log2((F.col("known") + 0.01) / (F.col("best") + 0.01))).cast("int"))
    return facts.join(best, ["g", "field"]).select("g", "field", "value", "pattern", "known", gap.alias("bucket"))


def _em(patterns: DataFrame, start: dict[str, tuple[float, float]], rounds: int, tolerance: float) -> tuple[dict, dict]:
    """Parameters after EM over patterns (field, bucket, pattern, n): {(field, cls): (sens, spec)}, {(field, bucket): prior}.

    Goes on until no rate moves by more than tolerance; a warning tells if that is not so after the given rounds.
    """
    sources = patterns.select("field", F.explode("pattern.cls").alias("cls")).distinct().collect()  # one row per field and source class
    rates = {(r.field, r.cls): start.get(r.cls, (0.7, 0.8)) for r in sources}
    priors = {(r.field, r.bucket): 0.5 if r.bucket >= 0 else 0.2 for r in patterns.select("field", "bucket").distinct().collect()}  # ten buckets a field
    for _ in range(rounds):
        scored = posterior(patterns, rates, priors).withColumn("w", F.col("n") * F.col("p"))
        each = scored.select("field", "bucket", "n", "w", F.explode("pattern").alias("o"))
        got = each.groupBy("field", F.col("o.cls").alias("cls")).agg(
            F.sum(F.col("w") * F.col("o.pos")).alias("tp"), F.sum(F.col("w") * F.col("o.neg")).alias("fn"),
            F.sum((F.col("n") - F.col("w")) * F.col("o.pos")).alias("fp"), F.sum((F.col("n") - F.col("w")) * F.col("o.neg")).alias("tn"),
        ).collect()
        share = scored.groupBy("field", "bucket").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
        new = {(r.field, r.cls): ((r.tp + 2.0) / (r.tp + r.fn + 3.0), (r.tn + 4.0) / (r.tn + r.fp + 5.0)) for r in got}
        for (field, cls), (sens, spec) in list(new.items()):  # a corrected delivery is no better evidence than the one that corrects it
            if cls.endswith("-") and (over := new.get((field, cls[:-1] + "+"))):
                new[field, cls] = (min(sens, over[0]), min(spec, over[1]))
        moved = max((abs(a - b) for k in new for a, b in zip(new[k], rates[k], strict=True)), default=0.0)
        rates, priors = new, {(r.field, r.bucket): min(0.98, max(0.02, (r.w + 1.0) / (r.n + 2.0))) for r in share}
        if moved < tolerance:
            return rates, priors
    warnings.warn(f"rates still move by {moved:.4f} after {rounds} rounds", stacklevel=2)
    return rates, priors


def posterior(df: DataFrame, rates: dict, priors: dict) -> DataFrame:
    """df with log_odds and p, the probability that the fact is true, under the given parameters."""
    spark = df.sparkSession
    lr = [(f, c, math.log(se / (1 - sp)), math.log((1 - se) / sp)) for (f, c), (se, sp) in rates.items()]
    table = spark.createDataFrame(lr, "field string, cls string, yes double, no double") if lr else spark.createDataFrame([], "field string, cls string, yes double, no double")
    per_field = table.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("cls", F.struct("yes", "no")))).alias("lr"))
    prior = spark.createDataFrame([(f, b, math.log(p / (1 - p))) for (f, b), p in priors.items()] or [("", 0, 0.0)], "field string, bucket int, prior double")
    total = F.aggregate("pattern", F.col("prior"), lambda acc, o: acc + o.pos * F.col("lr")[o.cls].yes + o.neg * F.col("lr")[o.cls].no)
    out = df.join(F.broadcast(per_field), "field").join(F.broadcast(prior), ["field", "bucket"])  # sized by fields and sources, not by rows
    return out.withColumn("log_odds", total).drop("lr", "prior").withColumn("p", 1 / (1 + F.exp(-F.col("log_odds"))))


def judged_facts(claims: DataFrame, trust: dict[str, int] | None = None, standing: DataFrame | None = None, rounds: int = 100, tolerance: float = 2e-3) -> DataFrame:
    """(g, field, value, known, log_odds, p, is_true) of every value claimed; a multi-valued field keeps all with is_true.

    claims: (g, field, value, source, at).  trust: source -> rank, 1 the most reliable, only the starting
    point of the inference.  standing: (field, value, known): how well a value is known beyond its group.
    """
    facts = stash(_facts(claims, standing), "facts")
    patterns = facts.groupBy("field", "bucket", "pattern").agg(F.count("*").alias("n"))
    patterns = stash(patterns, "patterns")
    start = {}
    for source, rank in (trust or {}).items():
        start[f"{source}+"], start[f"{source}-"] = (max(0.5, 0.95 - 0.1 * rank), 0.9), (max(0.4, 0.8 - 0.1 * rank), 0.85)
    rates, priors = _em(patterns, start, rounds, tolerance)
    return posterior(facts, rates, priors).select("g", "field", "value", "known", "log_odds", "p", (F.col("p") >= TRUE_AT).alias("is_true"))


def survivors(rows: DataFrame, group: str, fields: dict[str, Column], source: str, when: str, trust: dict[str, int] | None = None, standing: DataFrame | None = None) -> DataFrame:
    """One row per non-null group: g and, as text, the most probable value of each field; null where no row has one.

    Ties go to the better known value, then to the longer, then to the smaller text.  Repeated rows of one delivery must be
    removed by the caller, as they would count twice; extra columns are ignored; an empty table gives no rows.
    """
    judged = judged_facts(_claims(rows, group, fields, source, when), trust, standing)
    order = F.struct((-F.round("log_odds", 9)).alias("o"), (-F.col("known")).alias("k"), (-F.length("value")).alias("n"), "value")
    best = judged.groupBy("g").agg(*[F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, order)).alias(f) for f in fields])
    groups = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g")).distinct()
    return groups.join(best, "g", "left")


def name_standing(people: DataFrame) -> DataFrame:
    """(field, value, known): how many rows (distinct ids with their names) hold a plain value as fname or sname, damped by the share it has in the other column.

    A misspelling or nickname is far rarer than the name written out, and a swapped surname mostly stands elsewhere.
    Initials get no standing.
    """
    once = people.select("id", "fname", "sname").distinct()
    named = F.array(*[F.struct(F.lit(f).alias("field"), plain_or_null(f).alias("value")) for f in ("fname", "sname")])
    counts = once.select(F.explode_outer(named).alias("c")).where("c.value is not null").groupBy("c.value").agg(
        F.count(F.when(F.col("c.field") == "fname", 1)).alias("fname"), F.count(F.when(F.col("c.field") == "sname", 1)).alias("sname")
    )
    both = F.col("fname") + F.col("sname")
    each = F.explode_outer(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) * F.pow(F.col(f) / both, 2)).alias("known")) for f in ("fname", "sname")]))
    return counts.where(F.length("value") > 1).select("value", each.alias("s")).select("s.field", "value", "s.known").where("known > 0")


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column], dict[str, int], DataFrame]:
    """(rows of known groups, each once; fields; trust of the channels; standing of the values) of people_dict."""
    people = read(spark, sf_dir, "people_dict").select("id", "entity_id", "fname", "sname", "year", "feed", "loaded_at")
    trust = {r.feed: r.trust for r in read(spark, sf_dir, "feeds").collect()}  # a fixed table of channels
    members = people.where("entity_id is not null").groupBy("id", "entity_id", "feed").agg(
        F.max_by(F.struct("fname", "sname", "year"), "loaded_at").alias("r"), F.max("loaded_at").alias("loaded_at")
    ).select("id", "entity_id", "feed", "loaded_at", "r.fname", "r.sname", "r.year")
    named = F.array(*[F.struct(F.lit(f).alias("field"), plain_or_null(f).alias("value")) for f in ("fname", "sname")])
    wanted = members.select(F.explode_outer(named).alias("c")).select("c.field", "c.value").distinct()
    standing = name_standing(people).join(wanted, ["field", "value"], "left_semi")
    fields = {"fname": plain_or_null("fname"), "sname": plain_or_null("sname"), "year": F.when(F.col("year") > 0, F.col("year"))}
    years = members.where("year > 0").select(F.lit("year").alias("field"), F.col("year").cast("string").alias("value"), F.lit(1.0).alias("known")).distinct()
    return members, fields, trust, standing.unionByName(years)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, fields, trust, standing = _deliveries(spark, sf_dir)
    best = survivors(members, "entity_id", fields, "feed", "loaded_at", trust, standing)
    return best.select(F.col("g").alias("entity_id"), "fname", "sname", F.col("year").cast("int").alias("year"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that is judged true of a group, with its probability: several of one field where several are."""
    members, fields, trust, standing = _deliveries(spark, sf_dir)
    judged = judged_facts(_claims(members, "entity_id", fields, "feed", "loaded_at"), trust, standing)
    return judged.where("is_true").select(F.col("g").alias("entity_id"), "field", "value", F.round("p", 6).alias("p"))


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_values": p5_values}
