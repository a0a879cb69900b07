import re

import numpy as np
import pandas as pd
import pytest

from mergekin.llm import p8_reading as R

EASY = "We sang the red song. The dog ran to the shop. She had a big map. "
HARD = "Notwithstanding considerable methodological heterogeneity, the historiographical reconstruction presupposes epistemological commitments, insofar as interdependence persists. "


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    rows = [(i, "s", (EASY if i % 2 == 0 else HARD) * int(rng.integers(2, 6)), 1 if i % 2 == 0 else 5) for i in range(40)]
    return R.fit(pd.DataFrame(rows, columns=["doc_id", "source", "text", "level"]))


def test_learns_easy_from_hard(model):
    assert R.level_of_grade(model.grades([EASY * 4, HARD * 3])).tolist() == [1, 5]
    assert (R.level_of_grade(model.held_out["grade"].to_numpy()) == model.held_out["level"]).mean() == 1.0


def test_odd_texts(spark, model):
    rows = [(1, None, "x", 2.0), (2, "", "x", 2.0), (3, "1234 !!", "x", 2.0), (4, EASY * 5000, "x", 2.0), (5, "a", "x", 2.0), (6, "<p>" + HARD * 3 + "</p>", "x", 2.0)]
    got = {r.doc_id: r for r in R.graded(spark.createDataFrame(rows, "doc_id long, text string, language string, grade double"), model).collect()}
    assert len(got) == 6 and all(got[i].level is None and got[i].grade is None for i in (1, 2, 3))
    assert got[4].level == 1 and got[4].language == "en" and got[6].level == 5
    assert R.graded(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_languages():
    w = R.Words()
    texts = ["de man en de vrouw zijn niet op het feest", "der mann und die frau sind nicht auf dem fest", "le chat et la souris sont dans une maison avec les enfants", "the cat and the mouse were in a house", "", None]
    assert R.language(R.Texts.of(texts, w), w) == ["nl", "de", "fr", "en", "", ""]


def one_by_one(text, level_of, middle):
    """The plain way to the features that need no window: a check on the flat arrays."""
    clean = R._TAG.sub(" ", text).lower()
    sentences = [[p for p in R._PIECE.findall(s) if p[0].isalpha()] for s in re.split(r"[.!?;]+(?=\s|$)|\n\s*\n", clean)]
    sentences = [s for s in sentences if s]
    words = [w for s in sentences for w in s]
    level = np.array([level_of.get(w, middle) for w in words])
    sets = [{w for w in words[i : i + R.SPAN] if w not in R._ENGLISH} for i in range(0, max(1, len(words) - R.SPAN // 2), R.SPAN // 2)]
    cohesion = [len(x & y) / max(1, min(len(x), len(y))) for x, y in zip(sets, sets[2:], strict=False)]
    spans = [level[i : i + R.SPAN].mean() for i in range(0, max(1, len(words) - R.SPAN // 2), R.SPAN // 2)]
    return [*np.quantile(spans, (0.1, 0.25, 0.5, 0.75, 0.9)), *np.quantile([len(s) for s in sentences], (0.1, 0.25, 0.5, 0.75, 0.9)), *(np.quantile(cohesion, (0.25, 0.5, 0.75)) if cohesion else [0] * 3), len(set(words)) / len(words)]


def test_flat_features_against_one_text_at_a_time():
    texts = [EASY, HARD * 4, "", EASY * 3 + HARD, "<b>One</b> word", None, "No stop at all but it's long " * 9]
    vocabulary = {"song": 1.0, "methodological": 5.0, "the": 2.5}
    w = R.Words()
    t = R.Texts.of(texts, w)
    x = R.features(t, w, w.levels(vocabulary), 3.0)
    for i, text in enumerate(texts):
        if text:
            assert np.allclose([*x[i, :5], *x[i, 18:23], *x[i, 25:28], x[i, 38]], one_by_one(text, vocabulary, 3.0)), i
        else:
            assert not x[i].any()
    part = R.features(t.take(np.array([3, 1])), w, w.levels(vocabulary), 3.0)
    assert np.allclose(part, x[[3, 1]])


def test_calibration_rises_and_meets_means():
    grade, level = np.array([1.0, 1.2, 2.0, 2.1, 3.0]), np.array([1.0, 2.0, 1.0, 3.0, 3.0])
    at, to = R.isotonic(grade, level)
    assert (np.diff(at) > 0).all() and (np.diff(to) > 0).all() and to[0] == 1.0 and to[1] == 1.5 and to[-1] == 3.0
    assert R.level_of_grade(np.array([0.2, 1.49, 2.5, 9.0])).tolist() == [1, 1, 3, 5]


def test_boosting_fits_a_step():
    x = np.random.default_rng(1).random((400, 3))
    y = (x[:, 1] > 0.5) * 2.0 + 1
    p = R.boost(x[:300], y[:300]).predict(x[300:])
    assert np.abs(p - y[300:]).mean() < 0.15


def test_held_out_accuracy_on_labelled_texts(spark):
    sf = "/root/testdata/sf0.1"
    sample = R.labelled_sample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/reading_labels.parquet"))
    m = R.fit(sample)
    assert (R.level_of_grade(m.held_out["grade"].to_numpy()) == m.held_out["level"]).mean() > 0.9


def test_no_labels():
    m = R.fit(pd.DataFrame({"doc_id": [], "source": [], "text": [], "level": []}))
    assert m.grades(["a b c"]).shape == (1,)
