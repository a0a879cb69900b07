"""From values to candidate pairs: alike values, evidence of record pairs, acceptance and weighted scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergekin.config import Rule, comparator_of
from mergekin.functions import phonetic
from mergekin.functions.compare import sorted_words
from mergekin.functions.columns import abs_difference, edit_dist, encode_udf, similarity

Compare = Callable[[Column, Column], Column]


def _compare(attribute: str, text: str | Compare) -> Compare:
    if comparator_of(attribute) == "MAD":
        return lambda a, b: abs_difference(a.try_cast("double"), b.try_cast("double"))
    return similarity(text) if isinstance(text, str) else text


def value_blocks(values: DataFrame, key: str | Callable[[Column], Column] = "dmetaphone4") -> DataFrame:
    """(v, block): each distinct value under the phonetic key of each of its words."""
    words = values.select("v", F.explode(F.array_distinct(F.filter(F.split("v", r"\s+"), lambda w: w != ""))).alias("w"))
    coded = words.select("w").distinct()
    coded = coded.withColumn("block", encode_udf(key)("w") if isinstance(key, str) else key(F.col("w")))
    return words.join(coded, "w").where("block != ''").select("v", "block").distinct()


_SIGNED = "n int, h1 int, h2 int, few long, many long"


def _signed(blocked: DataFrame, ordered: bool) -> DataFrame:
    """(v, block) with what bounds a likeness: the length, the first two letters, and the bag of letters as bits, up to four of each (ordered: of the words in order)."""

    def look(v: str) -> tuple[int, int, int, int, int]:
        text = sorted_words(v) if ordered else v
        bits, seen = 0, {}
        for c in text:
            k = ord(c)
            seen[k] = times = seen.get(k, -1) + 1
            if 97 <= k <= 122:
                bits |= 1 << (4 * (k - 97) + min(times, 3))
            else:
                bits |= 1 << (104 + k - 48 if 48 <= k <= 57 else 114 + k % 12)
        return len(text), ord(text[0]) if text else -1, ord(text[1]) if len(text) > 1 else -1, bits & (1 << 63) - 1, bits >> 63

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        for x in batches:
            values = x.column("v").to_pylist()
            known = {v: look(v) for v in dict.fromkeys(values)}
            rows = [known[v] for v in values]
            more = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([x.column("v"), x.column("block"), *more], names=["v", "block", "n", "h1", "h2", "few", "many"])

    return blocked.select("v", "block").mapInArrow(sign, f"v string, block string, {_SIGNED}")


def _may_be_alike(text: str | Compare, min_sim: float) -> Column:
    """Whether two signed values (columns with _1 and _2) can be min_sim alike at all: never false for a pair that the comparator finds so.

    Letters of which one value has more than the other cannot match.  So many edits are needed at least, and Jaro is at most what the others give
    without a crossing; Winkler raises it by the beginning that the values share.
    """
    gone = lambda a, b: sum(F.bit_count(F.col(f"{c}_{a}").bitwiseAND(F.bitwise_not(F.col(f"{c}_{b}")))) for c in ("few", "many"))
    n1, n2 = F.col("n_1"), F.col("n_2")
    if text is edit_dist:
        return F.greatest(gone(1, 2), gone(2, 1)) <= (1 - min_sim) * F.greatest(n1, n2) + 1e-9
    common = F.least(n1 - gone(1, 2), n2 - gone(2, 1)).cast("double")
    jaro = (common / n1 + common / n2 + 1) / 3
    k = F.when(F.col("h1_1") != F.col("h1_2"), 1).when(F.col("h2_1") != F.col("h2_2"), 2).otherwise(3)
    return (n1 > 0) & (n2 > 0) & (jaro + 0.1 * k * (1 - jaro) >= min_sim - 1e-9)


def alike_values(left: DataFrame, right: DataFrame | None, attribute: str, column: str, min_sim: float, text: str | Compare = "sortwinkler", key: str | Callable[[Column], Column] = "dmetaphone4", blocks: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(attr, v1, v2, sim) of distinct values of left and right that share a block and are at least min_sim alike.

    With right None the values are compared among themselves, each pair once with v1 < v2; equal values are alike without a look.
    The comparator only sees distinct pairs.  blocks: makes (v, block) of (v) in place of the phonetic keys of words.
    """
    a = left.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    b = a if right is None else right.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    if comparator_of(attribute) == "MAD":
        # Numbers within the reach of the comparator: each value meets the ten units around it.
        reach = F.explode(F.sequence(F.floor(F.col("v").try_cast("double")).cast("long") - 10, F.floor(F.col("v").try_cast("double")).cast("long") + 10))
        x = a.where(F.col("v").try_cast("double").isNotNull()).select("v", reach.alias("block"))
        y = b.where(F.col("v").try_cast("double").isNotNull()).select("v", F.floor(F.col("v").try_cast("double")).cast("long").alias("block"))
    else:
        blocked = blocks or (lambda df: value_blocks(df, key))
        x, y = blocked(a), blocked(b)
    # A few values of a block make many pairs, whose comparison is pushed into the join: by their bytes the blocks would be left to very few tasks.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounded = comparator_of(attribute) != "MAD" and (text == "sortwinkler" or text is edit_dist) and min_sim > 0
    if bounded:
        x, y = (_signed(df, text == "sortwinkler").withColumnsRenamed({c: f"{c}_{k}" for c in ("n", "h1", "h2", "few", "many")}) for k, df in ((1, x), (2, y)))
    x, y = x.withColumnRenamed("v", "v1").repartition(tasks, "block"), y.withColumnRenamed("v", "v2").repartition(tasks, "block")
    pairs = x.join(y, "block").where("v1 < v2" if right is None else "v1 != v2")
    pairs = pairs.where(_may_be_alike(text, min_sim)) if bounded else pairs
    if text is edit_dist:
        pairs = pairs.where(edit_dist("v1", "v2") >= min_sim)
    pairs = pairs.select("v1", "v2").distinct()
    scored = pairs.withColumn("sim", _compare(attribute, text)(F.col("v1"), F.col("v2"))).where(F.col("sim") >= min_sim)
    same = (a if right is None else a.join(b, "v")).select(F.col("v").alias("v1"), F.col("v").alias("v2"), F.lit(1.0).alias("sim"))
    return same.unionByName(scored).select(F.lit(attribute).alias("attr"), "v1", "v2", "sim")


def phrase_keys(values: DataFrame, code: str = "dmetaphone4") -> DataFrame:
    """(v, block): each distinct value under the set of its words' phonetic codes and under that set less any one code.

    Phrases of many common words share a block only if all their words but one sound alike, so a block stays small where a word's own would
    hold a large part of the values.  Words of three letters or fewer do not count where there are longer ones.  A phrase of one word has its
    code only.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = phonetic.encoder(code), {}
        for x in batches:
            v, block = [], []
            for value in x.column(0).to_pylist():
                codes, words = set(), value.split()
                for w in [w for w in words if len(w) > 3] or words:
                    if w not in known:
                        known[w] = encode(w)
                    codes.add(known[w])
                codes = sorted(codes - {""})
                sets = [codes, *(codes[:i] + codes[i + 1 :] for i in range(len(codes)) if len(codes) > 1)]
                for one in sets if codes else []:
                    v.append(value)
                    block.append(" ".join(one))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(block, pa.string())], names=["v", "block"])

    return values.select("v").mapInArrow(keys, "v string, block string")


def alike_phrases(left: DataFrame, right: DataFrame | None, attribute: str, column: str, min_sim: float, text: str | Compare = "sortwinkler", code: str = "dmetaphone4") -> DataFrame:
    """alike_values for texts of several words, under phrase_keys()."""
    return alike_values(left, right, attribute, column, min_sim, text, blocks=lambda df: phrase_keys(df, code))


def alike_by_edits(values: DataFrame, min_sim: float) -> DataFrame:
    """(v1, v2) of all values v, in both orders and each with itself, that edit_dist finds at least min_sim alike; min_sim above 0.5.

    Without a block, and complete: k edits leave one of k + 1 segments of the shorter value as it was, so it stands in the longer one, no further
    from its place than the edits before and after it allow.
    """
    v = values.select("v", F.length("v").alias("n")).where("n > 0").distinct()
    start = "(i * l) div (k + 1)"
    size = f"((i + 1) * l) div (k + 1) - {start}"
    edits = lambda n: f"cast(floor({1 - min_sim} * {n} + 1e-9) as int)"
    kept = f"flatten(transform(sequence({edits('n')}, {edits(f'n / {min_sim}')}), k -> transform(sequence(0, k), i -> xxhash64(l, k, i, substring(v, cast({start} as int) + 1, cast({size} as int))))))"
    fits = f"abs(s) + abs(n - l - s) <= k and {start} + s >= 0"
    sought = f"flatten(transform(sequence(cast(ceil({min_sim} * n - 1e-9) as int), n), l -> flatten(transform(sequence(0, k), i -> transform(filter(sequence(-k, k), s -> {fits}), s -> xxhash64(l, k, i, substring(v, cast({start} + s as int) + 1, cast({size} as int))))))))"
    short = v.withColumn("l", F.col("n")).select(F.col("v").alias("v2"), F.col("n").alias("n2"), F.explode(F.expr(kept)).alias("segment"))
    long = v.withColumn("k", F.expr(edits("n"))).select(F.col("v").alias("v1"), F.col("n").alias("n1"), F.explode(F.expr(sought)).alias("segment"))
    pairs = long.join(short, "segment").where("n1 > n2 or (n1 = n2 and v1 < v2)").where(edit_dist("v1", "v2") >= min_sim).select("v1", "v2").distinct()
    same = v.select(F.col("v").alias("v1"), F.col("v").alias("v2"))
    return same.unionByName(pairs).unionByName(pairs.select(F.col("v2").alias("v1"), F.col("v1").alias("v2")))


def _both_ways(atomic: DataFrame) -> DataFrame:
    return atomic.select("attr", "v1", "v2", "sim").unionByName(atomic.where("v1 != v2").select("attr", F.col("v2").alias("v1"), F.col("v1").alias("v2"), "sim"))


def _values(df: DataFrame, id_column: str, attributes: list[str], r: str, v: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("v")) for a in attributes])).alias("x")
    return df.select(F.col(id_column).alias(r), each).select(r, "x.attr", F.col("x.v").alias(v)).where(f"{v} is not null")


def pair_evidence(left: DataFrame, right: DataFrame, atomic: DataFrame, attributes: list[str], id_column: str = "id", ordered: bool = False, drive: list[str] | None = None) -> DataFrame:
    """(r1, r2, attr, sim): record pairs that have alike values in an attribute, in either order of the value pair.

    An inverted index: each record appears under its values, so only pairs with evidence arise.  With drive, pairs arise only where all of
    these attributes are alike, from one join on all of them, and the other attributes are looked up for those pairs; so a value that tells little,
    such as a year, never makes pairs by itself.  With ordered, left and right are the same records and each pair comes once with r1 < r2.
    """
    both = _both_ways(atomic)
    rest = [a for a in attributes if a not in (drive or [])]
    if not drive:
        found = _values(left, id_column, attributes, "r1", "v1").join(both, ["attr", "v1"]).join(_values(right, id_column, attributes, "r2", "v2"), ["attr", "v2"])
        found = found.where("r1 < r2") if ordered else found
        return found.groupBy("r1", "r2", "attr").agg(F.max("sim").alias("sim"))
    wide = left.select(F.col(id_column).alias("r1"), *[F.col(a).cast("string").alias(f"_{a}_1") for a in drive])
    for a in drive:
        wide = wide.join(both.where(F.col("attr") == a).select(F.col("v1").alias(f"_{a}_1"), F.col("v2").alias(f"_{a}"), F.col("sim").alias(f"_{a}_sim")), f"_{a}_1")
    other = right.select(F.col(id_column).alias("r2"), *[F.col(a).cast("string").alias(f"_{a}") for a in drive])
    pairs = wide.join(other, [f"_{a}" for a in drive])
    pairs = pairs.where("r1 < r2") if ordered else pairs
    pairs = pairs.groupBy("r1", "r2").agg(*[F.max(f"_{a}_sim").alias(f"_{a}_sim") for a in drive])
    sims = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"_{a}_sim").alias("sim")) for a in drive])).alias("x")
    found = pairs.select("r1", "r2", sims).select("r1", "r2", "x.attr", "x.sim")
    return found.unionByName(evidence_of(pairs, left, right, atomic, rest, id_column)) if rest else found


def evidence_of(pairs: DataFrame, left: DataFrame, right: DataFrame, atomic: DataFrame, attributes: list[str], id_column: str = "id") -> DataFrame:
    """(r1, r2, attr, sim) of given pairs: the best alike pair of values that their records hold in each attribute. A record may have several rows."""
    more = pairs.select("r1", "r2").join(_values(left, id_column, attributes, "r1", "v1"), "r1").join(_values(right, id_column, attributes, "r2", "v2"), ["r2", "attr"]).join(_both_ways(atomic), ["attr", "v1", "v2"])
    return more.groupBy("r1", "r2", "attr").agg(F.max("sim").alias("sim"))


def addable_pairs(evidence: DataFrame) -> DataFrame:
    """(r1, r2): pairs with any evidence at all, as are let in while values propagate."""
    return evidence.where("sim > 0").select("r1", "r2").distinct()


def list_average(a: Column, b: Column, compare: Compare) -> Column:
    """Mean of the positive similarities of all pairs of values from two arrays; 0 if there are none."""
    sims = F.filter(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: compare(x, y)))), lambda v: v > 0)
    return F.when(F.size(sims) > 0, F.aggregate(sims, F.lit(0.0), lambda acc, v: acc + v) / F.size(sims)).otherwise(0.0)


def driving(rule: Rule) -> list[str] | None:
    """The attributes that every accepted pair has alike, if the rule tells."""
    need = [a for c in (rule.must, rule.core, rule.extra) if c.least and c.least == len(c.attributes) for a in c.attributes]
    return need or None


def accepted_pairs(evidence: DataFrame, rule: Rule) -> DataFrame:
    """(r1, r2, n_must, n_core, n_extra) of pairs with enough alike attributes in every category of the rule."""
    of = rule.category_of()
    cat, least = F.lit(None).cast("string"), F.lit(2.0)
    for attribute, (name, min_sim) in of.items():
        cat = F.when(F.col("attr") == attribute, name).otherwise(cat)
        least = F.when(F.col("attr") == attribute, min_sim).otherwise(least)
    good = evidence.where(F.col("attr").isin(list(of))).withColumn("cat", cat).where(F.col("sim") >= least)
    counts = good.groupBy("r1", "r2").agg(*[F.count(F.when(F.col("cat") == c, 1)).alias(f"n_{c}") for c in ("must", "core", "extra")])
    need = {"must": rule.must.least, "core": rule.core.least, "extra": rule.extra.least}
    for c, n in need.items():
        counts = counts.where(F.col(f"n_{c}") >= n)
    return counts


def _matched(rule: Rule) -> dict[str, list[Column]]:
    """Of each category, the likenesses that count, one column an attribute; null where the pair's are too low or unknown."""
    of = {c: [] for c in ("must", "core", "extra")}
    for attribute, (name, min_sim) in rule.category_of().items():
        of[name].append(F.when(F.col(attribute) >= min_sim, F.col(attribute).cast("double")))
    return of


def accepted_wide(pairs: DataFrame, rule: Rule) -> DataFrame:
    """accepted_pairs of pairs that come once each, with a column of likeness for every attribute of the rule: no shuffle, other columns stay out."""
    of = _matched(rule)
    count = lambda c: sum((F.when(x.isNotNull(), 1).otherwise(0) for x in of[c]), F.lit(0)).cast("long").alias(f"n_{c}")
    need = {"must": rule.must.least, "core": rule.core.least, "extra": rule.extra.least}
    # evidence: a pair without any alike value has no row
    return pairs.select("r1", "r2", *[count(c) for c in need]).where(" and ".join(f"n_{c} >= {n}" for c, n in need.items())).where("n_must + n_core + n_extra > 0")


def weighted_wide(pairs: DataFrame, rule: Rule) -> DataFrame:
    """weighted_scores of pairs that come once each, with a column of likeness for every attribute of the rule."""
    of = _matched(rule)
    n_must, n_core = len(of["must"]), len(of["core"])
    if not n_must and not n_core:
        raise ValueError("a rule needs must or core attributes")
    total = lambda c: sum((F.coalesce(x, F.lit(0.0)) for x in of[c]), F.lit(0.0))
    extra = F.try_divide(total("extra"), sum((F.when(x.isNotNull(), 1).otherwise(0) for x in of["extra"]), F.lit(0)))
    must = total("must") / n_must if n_must else total("core") / n_core
    core = total("core") / n_core if n_core else total("must") / n_must
    score = F.when(extra.isNull(), 0.3 * core + 0.7 * must).otherwise(0.2 * core + 0.6 * must + 0.2 * extra)
    return pairs.withColumn("sim_attr", score)


def weighted_scores(evidence: DataFrame, rule: Rule) -> DataFrame:
    """(r1, r2, sim_attr): must and core averages over the attributes configured, the extra average over those matched.

    Without extra evidence 0.7 must + 0.3 core, with it 0.6 must + 0.2 core + 0.2 extra; a category without attributes
    borrows the other's average.
    """
    of = rule.category_of()
    cat, least = F.lit(None).cast("string"), F.lit(2.0)
    for attribute, (name, min_sim) in of.items():
        cat = F.when(F.col("attr") == attribute, name).otherwise(cat)
        least = F.when(F.col("attr") == attribute, min_sim).otherwise(least)
    good = evidence.where(F.col("attr").isin(list(of))).withColumn("cat", cat).where(F.col("sim") >= least)
    n_must, n_core = len(rule.must.attributes), len(rule.core.attributes)
    if not n_must and not n_core:
        raise ValueError("a rule needs must or core attributes")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("cat") == c, F.col("sim"))), F.lit(0.0))
    sums = good.groupBy("r1", "r2").agg(total("must").alias("must"), total("core").alias("core"), F.avg(F.when(F.col("cat") == "extra", F.col("sim"))).alias("extra"))
    must = F.col("must") / n_must if n_must else F.col("core") / n_core
    core = F.col("core") / n_core if n_core else F.col("must") / n_must
    score = F.when(F.col("extra").isNull(), 0.3 * core + 0.7 * must).otherwise(0.2 * core + 0.6 * must + 0.2 * F.col("extra"))
    return sums.select("r1", "r2", score.alias("sim_attr"))


def ambiguity(freq1: Column, freq2: Column, universe: Column | int) -> Column:
    """1 - ln(f1 + f2) / ln(universe): near 1 for rare names; null if the universe has one record or none, or the frequencies are not positive."""
    n, f = (F.lit(universe) if isinstance(universe, int) else universe).cast("double"), (freq1 + freq2).cast("double")
    return F.when((n > 1) & (f > 0), 1 - F.ln(f) / F.ln(n))


def combined_score(sim_attr: Column, sim_amb: Column, weight: float) -> Column:
    return weight * sim_attr + (1 - weight) * sim_amb


def attribute_linkage(left: DataFrame, right: DataFrame, atomic: DataFrame, rule: Rule, merge_t: float, id_column: str = "id", ordered: bool = False) -> DataFrame:
    """The attribute-similarity baseline: accepted pairs whose weighted score is at least merge_t; no clustering."""
    attributes = list(rule.category_of())
    evidence = pair_evidence(left, right, atomic, attributes, id_column, ordered, driving(rule))
    return accepted_pairs(evidence, rule).select("r1", "r2").join(weighted_scores(evidence, rule), ["r1", "r2"]).where(F.col("sim_attr") >= merge_t)


def dep_graph_score(sim_attr: Column, merged_strong: Column, merged_weak: Column) -> Column:
    """Score of the dependency-graph baseline; not capped at 1."""
    return 0.9 * sim_attr + 0.1 * merged_strong + 0.05 * merged_weak


def relationship_average(merged_strong: Column, merged_weak: Column, strong: Column, weak: Column) -> Column:
    return F.coalesce(F.try_divide(2 * merged_strong + merged_weak, 2 * strong + weak), F.lit(0.0))


def top_means(sims: Column, k: int) -> Column:
    """Mean of the k largest of an array; null if it is empty."""
    top = F.slice(F.sort_array(sims, asc=False), 1, k)
    return F.when(F.size(top) > 0, F.aggregate(top, F.lit(0.0), lambda acc, x: acc + x) / F.size(top))
