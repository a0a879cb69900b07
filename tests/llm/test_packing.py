import numpy as np
import pytest

from mergekin.llm import p6_packing as P
from mergekin.llm.tokens import with_token_counts


def check(rows, items, caps, share, a_document):
    for cls, cap in caps.items():
        mine = [r for r in rows if r.bin_class == cls]
        got = {}
        for r in mine:
            got.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        for d, n in items.items():
            spans = sorted(got.get(d, []))
            assert sum(k for _, k in spans) == (n or 0)
            assert [s for s, _ in spans] == list(np.cumsum([0, *(k for _, k in spans)])[:-1])
            assert len(spans) == -(-(n or 0) // cap)  # split only if longer than the capacity
        bins = {}
        for r in mine:
            bins.setdefault(r.container, []).append(r.n_tokens)
        for b in bins.values():
            assert sum(b) <= cap and (len(b) == 1 or (len(b) <= max(1, cap // a_document) and sum(x * x for x in b) <= share * cap * cap + 1e-6))
        yield cls, len(bins)


@pytest.mark.parametrize(("rule", "share", "shard", "a_document"), [("norm", 1.0, 20_000, 8), ("dot", 1.0, 100, 8), ("norm", 0.5, 50, 64), ("norm", 0.1, 50, 32)])
def test_every_item_is_laid_once_within_all_limits(spark, rule, share, shard, a_document):
    rng = np.random.default_rng(2)
    items = {i: int(x) for i, x in enumerate(rng.lognormal(4, 1.2, 300))} | {1000: 0, 1001: None, 1002: 100_000, 1003: 128, 1004: 129}
    caps = {"s": 128, "m": 512}
    df = spark.createDataFrame([(d, n, "x", 1) for d, n in items.items()], "doc_id long, n_tokens long, cap string, container int")
    bins = spark.createDataFrame([*caps.items(), ("none", None), ("zero", 0), ("s", 128)], "bin_class string, capacity_tokens int")
    used = dict(check(P.packed(df, bins, share, rule, shard, a_document).collect(), items, caps, share, a_document))
    if share == 1.0 and shard > 1000:
        total = sum(x or 0 for x in items.values())
        assert all(k <= total / caps[c] * 1.05 + 1 for c, k in used.items())


def test_limits_bind_and_are_reported(spark):
    items = spark.createDataFrame([(i, 10 if i < 40 else 45 if i < 80 else 90) for i in range(100)], "doc_id long, n_tokens long")
    bins = spark.createDataFrame([("s", 100)], "bin_class string, capacity_tokens int")
    r = P.filled(P.packed(items, bins, 0.5, tokens_a_document=25), bins, 0.5, 25).first()
    assert r.tight_attention == 20 and r.tight_documents > 0 and r.most_pieces == 4 and r.tight_tokens + r.tight_documents + r.tight_attention == r.containers


def test_empty(spark):
    bins = spark.createDataFrame([("s", 128)], "bin_class string, capacity_tokens int")
    assert P.packed(spark.createDataFrame([], "doc_id long, n_tokens long"), bins).count() == 0
    assert P.packed(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long"), bins.limit(0)).count() == 0


def test_optimal_where_it_is_easy():
    lengths = np.sort(np.array([60, 40, 70, 30, 50, 50, 99, 1]))[::-1]
    assert len(set(P.vector_best_fit(lengths, 100, 50, 1e9))) == 4


def test_token_counts(spark):
    rows = [(1, "hello world", "t"), (2, "", "t"), (3, None, "t"), (4, "word " * 20_000, "t"), (5, "<|endoftext|>", "t")]
    got = {r.doc_id: r.n_tokens for r in with_token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] >= 20_000 and got[5] > 1
