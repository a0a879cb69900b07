"""Evaluation against known links, and reports on data and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("link", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(link, tp, fp, fn, precision, recall, f_star) in per cent with two decimals; 0 where a divisor is 0.

    found, truth: (link, a, b), unordered pairs.
    """
    both = _pairs(found).withColumn("f", F.lit(1)).join(_pairs(truth).withColumn("t", F.lit(1)), ["link", "a", "b"], "full")
    counts = both.groupBy("link").agg(
        F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"),
    )
    share = lambda *parts: F.coalesce(F.round(F.try_divide(F.col("tp") * 100.0, sum((F.col(p) for p in parts), F.lit(0))), 2), F.lit(0.0))
    return counts.select("link", "tp", "fp", "fn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("tp", "fp", "fn").alias("f_star"))


def entity_links(members: DataFrame, roles: DataFrame, links: list[str]) -> DataFrame:
    """(link, a, b): pairs of records of one entity whose roles form a listed link, in either order.

    members: (record, entity); roles: (record, role).
    """
    held = members.join(roles, "record")
    other = held.select("entity", F.col("record").alias("b"), F.col("role").alias("role_b"))
    both = held.select("entity", F.col("record").alias("a"), F.col("role").alias("role_a")).join(other, "entity").where("a < b")
    forward, back = F.concat_ws("-", "role_a", "role_b"), F.concat_ws("-", "role_b", "role_a")
    return both.select(F.when(forward.isin(links), forward).when(back.isin(links), back).alias("link"), "a", "b").where("link is not null")


def entity_sizes(members: DataFrame) -> DataFrame:
    """(size, entities)."""
    return members.groupBy("entity").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("entities"))


def role_report(members: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, records, singles, single_share, least, most, mean): how many records of each role entities hold, and how many records are in none."""
    held = roles.join(members, "record", "left")
    per = held.where("entity is not null").groupBy("role", "entity").agg(F.count("*").alias("k")).groupBy("role").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))
    alone = held.groupBy("role").agg(F.count("*").alias("records"), F.count(F.when(F.col("entity").isNull(), 1)).alias("singles"))
    return alone.join(per, "role", "left").withColumn("single_share", F.round(F.col("singles") * 100.0 / F.col("records"), 2))


def type_counts(people: DataFrame) -> DataFrame:
    """Counts by role and sex with subtotals; null stands for all, '-' for unknown."""
    known = people.select(F.coalesce("role", F.lit("-")).alias("role"), F.coalesce("sex", F.lit("-")).alias("sex"))
    return known.rollup("role", "sex").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """(n, missing, distinct, least, most) of a column as text."""
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.count(F.when(c.isNull(), 1)).alias("missing"), F.count_distinct(c).alias("distinct_values"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most"))


def yearly_trend(df: DataFrame, year: Column, first: int, last: int) -> DataFrame:
    """(year, n) for every year of the range, 0 where there is none."""
    spine = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    counts = df.select(year.cast("int").alias("year")).where(F.col("year").between(first, last)).groupBy("year").agg(F.count("*").alias("n"))
    return spine.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def gap_histogram(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    return pairs.select(F.abs(a - b).alias("gap")).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


def id_parts(df: DataFrame, column: str, separator: str = "-") -> DataFrame:
    """(part, total, distinct_values) of every part of a composite id, by place."""
    each = df.select(F.posexplode(F.split(F.col(column), separator)).alias("part", "v"))
    return each.groupBy("part").agg(F.count("v").alias("total"), F.count_distinct("v").alias("distinct_values"))


def attribute_report(evidence: DataFrame, min_sim: float = 0.9) -> DataFrame:
    """(link, attr, n, alike, missing, mean) over pairs with one row per attribute and a null sim where a value is missing."""
    return evidence.groupBy("link", "attr").agg(F.count("*").alias("n"), F.count(F.when(F.col("sim") >= min_sim, 1)).alias("alike"), F.count(F.when(F.col("sim").isNull(), 1)).alias("missing"), F.round(F.avg("sim"), 6).alias("mean"))


def miss_reasons(truth: DataFrame, candidates: DataFrame, scored: DataFrame, merge_t: float) -> DataFrame:
    """(link, reason, n): why known links were not found: never a candidate, or scored too low, or turned down by a constraint."""
    missed = _pairs(truth).join(_pairs(candidates).withColumn("c", F.lit(1)), ["link", "a", "b"], "left").join(scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim"), ["a", "b"], "left")
    reason = F.when(F.col("c").isNull(), "no_candidate").when(F.coalesce("sim", F.lit(0.0)) < merge_t, "low_score").otherwise("constraint")
    return missed.select("link", reason.alias("reason")).groupBy("link", "reason").agg(F.count("*").alias("n"))


def unique_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose combination of columns occurs once and has no null."""
    w = Window.partitionBy(*columns)
    known = df.dropna(subset=columns)
    return known.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n")


def match_weights(pairs: DataFrame, attributes: list[str]) -> DataFrame:
    """(attr, m, u, w_agree, w_disagree): probabilities of agreement among matches and others, and the log10 weights; null where they are undefined.

    pairs: (matched boolean, and for each attribute <attr>_1, <attr>_2); pairs with a null value are left out of its row.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), (F.col(f"{a}_1") == F.col(f"{a}_2")).alias("same")) for a in attributes])).alias("x")
    each = pairs.select("matched", rows).select("matched", "x.attr", "x.same").where("same is not null")
    count = lambda c: F.count(F.when(c, 1))
    sums = each.groupBy("attr").agg(count(F.col("matched")).alias("n1"), count(F.col("matched") & F.col("same")).alias("k1"), count(~F.col("matched")).alias("n0"), count(~F.col("matched") & F.col("same")).alias("k0"))
    m, u = F.try_divide(F.col("k1"), F.col("n1")), F.try_divide(F.col("k0"), F.col("n0"))
    log = lambda a, b: F.when((a > 0) & (b > 0), F.log10(a / b))
    return sums.select("attr", m.alias("m"), u.alias("u"), log(m, u).alias("w_agree"), log(1 - m, 1 - u).alias("w_disagree"))


#: Links of the civil pipeline by the number of links among the relatives of both people; all others come alone.
ARITIES = {
    4: ["Mm-Dd", "Mm-Ds", "Mbp-Dp", "Mgp-Dp"],
    3: ["Bb-Mm", "Bp-Mbp", "Bp-Mgp", "Bb-Dd", "Bp-Dp", "Mm-Mm", "Mbp-Mbp", "Mgp-Mgp"],
    2: ["Bp-Bp", "Bp-Mm", "Bp-Dd", "Bp-Ds", "Mm-Mbp", "Mm-Mgp", "Mm-Dp", "Mbp-Dd", "Mbp-Ds", "Mgp-Dd", "Mgp-Ds", "Dd-Ds", "Dd-Dp", "Ds-Dp", "Dp-Dp"],
}


def link_arity(link: Column) -> Column:
    """How many links of relatives come with a link of the civil pipeline."""
    out = F.lit(1)
    for n, links in ARITIES.items():
        out = F.when(link.isin(links), n).otherwise(out)
    return out


#: Priorities of a first merge in the civil pipeline: the links' arity and the size of the group, in the order in which groups come.
PRIORITIES = {(4, 4): 1, (4, 3): 2, (3, 3): 3, (3, 2): 4, (2, 2): 5}


def bootstrap_priority(arity: Column, size: Column) -> Column:
    """The bucket of a group of that many nodes whose links have that arity; null for groups that are not merged first."""
    out = F.lit(None).cast("int")
    for (a, n), k in PRIORITIES.items():
        out = F.when((arity == a) & (size == n), k).otherwise(out)
    return out
