"""Known links: built from unique families, life segments and siblings, and put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergekin.operators.evaluate import unique_keys
from mergekin.operators.graphs import components


def unique_triangles(left: DataFrame, right: DataFrame, keys: list[str], optional: list[str] = ()) -> DataFrame:
    """(a, b): records whose keys occur once on their side and are equal on both; optional columns are equal too, two unknown ones being equal.

    left, right: (id, keys, optional).  Records with a null key are left out.
    """
    one, two = (unique_keys(df.select("id", *keys, *optional), keys) for df in (left, right))
    two = two.select(F.col("id").alias("b"), *[F.col(c).alias(f"_{c}") for c in (*keys, *optional)])
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in optional])
    return one.withColumnRenamed("id", "a").join(two, same).select("a", "b")


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(<keys>, n) of every combination without a null."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))


def life_segments(segments: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(person, role, record): the certificates of each life. segments: person and one column of record ids for each entry of roles (column -> role)."""
    each = F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).cast("string").alias("record")) for c, role in roles.items()])
    return segments.select("person", F.explode_outer(each).alias("x")).select("person", "x.role", "x.record").where("record is not null").distinct()


def segment_links(certificates: DataFrame, order: list[str]) -> DataFrame:
    """(link, a, b) between the certificates of one life, the role that comes first in order first; a life has few certificates."""
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("role"))
    c = certificates.withColumn("rank", rank).where("rank > 0")
    x, y = (c.select("person", F.col("role").alias(f"role{k}"), F.col("record").alias(n), F.col("rank").alias(f"rank{k}")) for k, n in ((1, "a"), (2, "b")))
    both = x.join(y, "person").where("rank1 < rank2 or (rank1 = rank2 and a < b)")
    return both.select(F.concat_ws("-", "role1", "role2").alias("link"), "a", "b").distinct()


def sibling_parents(children: DataFrame) -> DataFrame:
    """(record, parent): the mothers and fathers on the certificates of siblings, each with the least record of the same person.

    children: (sibset, relation, parent): a parent on one child's certificate.  Siblings share parents, and sets that share a record share them all,
    so the records are joined through their components rather than pair by pair.
    """
    first = children.groupBy("sibset", "relation").agg(F.min("parent").alias("first"))
    edges = children.join(first, ["sibset", "relation"]).select(F.col("parent").alias("src"), F.col("first").alias("dst"))
    return components(edges).select(F.col("v").alias("record"), F.col("component").alias("parent"))


def union_of(*truths: DataFrame) -> DataFrame:
    """(link, a, b): unordered pairs known from any of the truths, each once, a < b."""
    ordered = [t.select("link", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for t in truths]
    return reduce(lambda x, y: x.unionByName(y), ordered).where("a is not null and b is not null and a != b").distinct()


def entities_from(truth: DataFrame) -> DataFrame:
    """(entity, record): the groups that known links form, under their least record."""
    return components(truth, "a", "b").select(F.col("component").alias("entity"), F.col("v").alias("record"))


def parents_known(fname1: Column, fname2: Column) -> Column:
    """Whether a parent is named on both sides, so that a link can be told at all."""
    return fname1.isNotNull() & fname2.isNotNull()


def marriage_parents_known(mother_fname: Column, mother_sname: Column, father_fname: Column, father_sname: Column) -> Column:
    """Whether each parent has a forename or a surname."""
    return F.coalesce(mother_fname, mother_sname).isNotNull() & F.coalesce(father_fname, father_sname).isNotNull()
