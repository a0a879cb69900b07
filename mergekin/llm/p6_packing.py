"""Filling fixed-capacity containers with items.

Vector best fit.  A container has three residuals: tokens, documents and attention cost (the sum of squared
lengths).  Items go in by decreasing length; of the open containers that can take an item under all three limits the one
with the least weighted norm of what would be left is chosen (or, by choice, the largest weighted dot product of
demand and residual).  An empty container takes any item, so none is split for its attention cost: what is beyond the attention
limit stands alone.  Items are dealt out by a hash into shards of bounded size that are packed independently, so
each task holds a bounded number of items and at most the last containers of each shard stay partly empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin.llm.tokens import TOKENIZER, with_token_counts
from mergekin.session import read, stash

#: Pieces packed by one call.
SHARD_ITEMS = 5_000
#: Weights of the residual tokens, documents and attention cost.
WEIGHTS = (1.0, 0.05, 0.1)
#: The attention cost of a container of several documents is at most this share of the squared capacity.
ATTENTION_SHARE = 0.75
#: A container takes one document for each so many tokens of capacity.
TOKENS_A_DOCUMENT = 32


def vector_best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: float, rule: str = "norm", weights: tuple = WEIGHTS) -> np.ndarray:
    """The container number of every item, for items in decreasing order of length, none longer than the capacity."""
    demand = np.stack([lengths / capacity, np.full(len(lengths), 1 / max_docs), np.square(lengths.astype(float)) / max_attention], axis=1)
    w = np.asarray(weights, float)
    pull = demand * w
    room = np.empty((3, max(16, len(lengths) // 4 + 1)))  # residuals of the open containers, in shares of the limits
    norm, name = np.empty(room.shape[1]), np.empty(room.shape[1], np.int64)
    n_open, made, slack = 0, 0, 1e-12
    least = demand.min(axis=0) if len(lengths) else np.zeros(3)
    out = np.empty(len(lengths), np.int64)
    for i in range(len(lengths)):
        d0, d1, d2 = demand[i]
        at = -1
        if n_open:
            now = room[:, :n_open]
            fits = np.flatnonzero((now[0] >= d0 - slack) & (now[1] >= d1 - slack) & (now[2] >= d2 - slack))
            if len(fits):
                # |room - demand|^2 is |room|^2 - 2 room.demand and a constant
                score = pull[i] @ now[:, fits]
                at = int(fits[(2 * score - norm[fits] if rule == "norm" else score).argmax()])
        if at < 0:
            if n_open == room.shape[1]:
                room, norm, name = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([norm, norm]), np.concatenate([name, name])
            at, room[:, n_open], name[n_open] = n_open, 1.0, made
            n_open, made = n_open + 1, made + 1
        room[:, at] -= demand[i]
        out[i] = name[at]
        if (room[:, at] < least - slack).any():  # nothing fits in any more
            n_open -= 1
            room[:, at], norm[at], name[at] = room[:, n_open], norm[n_open], name[n_open]
        else:
            norm[at] = w @ np.square(room[:, at])
    return out


def packed(items: DataFrame, bins: DataFrame, max_attention_share: float = ATTENTION_SHARE, rule: str = "norm", shard_items: int = SHARD_ITEMS, tokens_a_document: int = TOKENS_A_DOCUMENT) -> DataFrame:
    """(bin_class, container, doc_id, piece, first_token, n_tokens): every item laid into containers of every class.

    items: (doc_id, n_tokens).  bins: (bin_class, capacity_tokens), a small table.  A container of several pieces holds at most capacity /
    tokens_a_document of them and an attention cost of max_attention_share of the squared capacity.  Only items longer than the capacity are
    split, into full pieces and a rest.  Items of null or no tokens take no room and are left out; a class with a null or non-positive capacity
    is left out; ties and repeated lengths go by the hash of doc_id; empty tables give no rows.
    """
    items = items.select("doc_id", "n_tokens").where("n_tokens > 0")
    share = float(max_attention_share)
    classes = bins.select("bin_class", F.col("capacity_tokens").cast("long").alias("cap")).where("cap > 0").distinct().collect()
    if len(classes) > 1000:
        raise ValueError("every item goes into every class; bins has more than 1000 classes")
    k = lambda c: F.ceil(F.col("n_tokens") / F.lit(c)).cast("int")
    sums = items.agg(*[F.coalesce(F.sum(k(c.cap)), F.lit(0)).alias(f"_{i}") for i, c in enumerate(classes)]).first() if classes else ()
    table = F.array(*[F.struct(F.lit(c.bin_class).alias("bin_class"), F.lit(c.cap).alias("cap"), F.lit(max(1, -(-n // shard_items))).alias("shards")) for c, n in zip(classes, sums, strict=True)]) if classes else None
    schema = f"bin_class {bins.schema['bin_class'].dataType.simpleString()}, doc_id {items.schema['doc_id'].dataType.simpleString()}, piece int, first_token long, n_tokens long, container long"
    if table is None:
        return items.sparkSession.createDataFrame([], schema)
    pieces = items.withColumn("c", F.explode(table)).select("doc_id", "n_tokens", "c.*")
    pieces = pieces.withColumn("k", F.explode_outer(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("cap")).cast("int") - 1)))
    pieces = pieces.select(
        "bin_class", "cap", "doc_id", F.col("k").alias("piece"), (F.col("k") * F.col("cap")).alias("first_token"), F.least("cap", F.col("n_tokens") - F.col("k") * F.col("cap")).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "k"), F.col("shards")).cast("int").alias("shard"), F.xxhash64("doc_id", "k", F.lit(1)).alias("h"),
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["cap"].iloc[0])
        pdf = pdf.sort_values(["n_tokens", "h", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        at = vector_best_fit(pdf["n_tokens"].to_numpy(), cap, max(1, cap // tokens_a_document), share * cap * cap, rule)
        out = pdf[["bin_class", "doc_id", "piece", "first_token", "n_tokens"]].copy()
        out["container"] = at + (pdf["shard"].to_numpy(np.int64) << 32)
        return out

    return pieces.groupBy("bin_class", "shard").applyInPandas(pack, schema)


def filled(packs: DataFrame, bins: DataFrame, max_attention_share: float = ATTENTION_SHARE, tokens_a_document: int = TOKENS_A_DOCUMENT) -> DataFrame:
    """Of every class: containers, tokens, the share of all capacity that is filled, and how many containers are tightest in tokens, documents, attention."""
    each = packs.groupBy("bin_class", "container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("cost"))
    each = each.join(bins.select("bin_class", F.col("capacity_tokens").alias("cap")), "bin_class")
    use = {"tokens": F.col("n") / F.col("cap"), "documents": F.col("pieces") / F.greatest(F.floor(F.col("cap") / tokens_a_document), F.lit(1)), "attention": F.col("cost") / (max_attention_share * F.col("cap") * F.col("cap"))}
    most = F.greatest(*use.values())
    tight = F.when(use["tokens"] == most, "tokens").when(use["documents"] == most, "documents").otherwise("attention")
    per = each.withColumn("tight", tight).groupBy("bin_class", "cap").agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.max("pieces").alias("most_pieces"), *[F.count_if(F.col("tight") == t).alias(f"tight_{t}") for t in use]
    )
    return per.withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("cap"))).withColumnRenamed("cap", "capacity_tokens")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stash(with_token_counts(read(spark, sf_dir, "documents"), ["doc_id"], path=TOKENIZER), "sizes")
    return packed(sizes, read(spark, sf_dir, "bins"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each class are filled, and by which limit."""
    return filled(p6_pack(spark, sf_dir), read(spark, sf_dir, "bins"))


SQL: dict[str, str] = {}
QUERIES = {"p6_pack": p6_pack, "p6_fill": p6_fill}
