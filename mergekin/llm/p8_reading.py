"""Reading level of each document.

Gradient-boosted regression trees over distributions of length, vocabulary, syntax and cohesion within a text.
The vocabulary features score each word by the levels of the labelled texts it stands in; in every fold, texts are scored by the
labels of texts that are neither in that fold nor in the text's own.  Grades of held-out folds calibrate the grades (isotonic
regression), and accuracy is reported for folds and for whole sources held out.  Texts are split once and all features are formed over flat arrays
of a batch's words.  Only the labelled sample comes to the driver; every document is scored where it lies, as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin.llm.p7_mixing import source_name
from mergekin.session import read

#: Labelled documents the model is fitted on at most; beyond it a hash of doc_id chooses.
MAX_LABELLED = 20_000
FOLDS = 5
#: Words of a window over which local distributions are taken; windows overlap by half.
SPAN = 16
#: Characters of text that are looked at in one go.
CHUNK = 1_000_000

#: Frequent function words by language, for telling the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in is was that it for with as his her on at by which or from had were this be are not they she he we who then has an".split(),
    "nl": "de het een en van is dat niet op te zijn met voor aan er door bij ook naar uit werd was hun haar zij deze die om wordt als".split(),
    "de": "der die das und ist nicht ein eine zu den von mit dem des im auf für wurde war sich auch als nach bei aus wird sie er es".split(),
    "fr": "le la les et des est une un dans que du pour qui par sur au avec pas ne se il elle sont aux ce cette été était leur".split(),
}
_LANGUAGES = list(FUNCTION_WORDS)
_ENGLISH = set(FUNCTION_WORDS["en"])
_LINKS = set("because although however therefore whereas unless while since but so when if which who that".split())

_TAG = re.compile(r"<[^<>]{1,60}>|&\w{2,6};")
_PIECE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;]+(?=\s|$)|\n\s*\n")
_VOWELS = re.compile(r"[aeiouyàâäéèêëîïôöùûü]+")


class Words:
    """Numbers for words and, by number, what the features need of them. Number 0 ends a sentence."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.words: list[str] = [""]
        self.rows: list[tuple] = [(0, 0, False, False, *(0.0 for _ in _LANGUAGES))]
        self.table = np.zeros((0, 4 + len(_LANGUAGES)))

    def numbers(self, text: str) -> list[int]:
        out, number = [], self.number
        for piece in _PIECE.findall(_TAG.sub(" ", text).lower()):
            k = number.get(piece)
            if k is None:
                k = self._new(piece)
            out.append(k)
        return out

    def _new(self, piece: str) -> int:
        if not piece[0].isalpha():
            k = 0
        else:
            k = len(self.words)
            held = [lang for lang in _LANGUAGES if piece in FUNCTION_WORDS[lang]]
            self.words.append(piece)
            self.rows.append((len(piece), max(1, len(_VOWELS.findall(piece))), piece in _ENGLISH, piece in _LINKS, *(1 / len(held) if lang in held else 0.0 for lang in _LANGUAGES)))
        self.number[piece] = k
        return k

    def known(self) -> np.ndarray:
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], float)])
        return self.table

    def levels(self, vocabulary: dict[str, float]) -> np.ndarray:
        return np.array([vocabulary.get(w, np.nan) for w in self.words])


@dataclass
class Texts:
    """The words of some texts, one after the other: word numbers, text and sentence of each, and the commas of each text."""

    word: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    commas: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], words: Words) -> Texts:
        each = [words.numbers(t) if t else [] for t in texts]
        flat = np.fromiter((k for one in each for k in one), np.int64)
        text = np.repeat(np.arange(len(texts)), [len(one) for one in each])
        stop = flat == 0
        # A sentence ends with its text too.
        sentence = np.cumsum(stop) + text
        return cls(flat[~stop], text[~stop], np.unique(sentence[~stop], return_inverse=True)[1], np.array([(t or "").count(",") for t in texts], float))

    def count(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.commas))

    def take(self, texts: np.ndarray) -> Texts:
        """The words of the given texts only, in the order given."""
        place = np.full(len(self.commas), -1)
        place[texts] = np.arange(len(texts))
        mine = np.flatnonzero(place[self.text] >= 0)
        mine = mine[np.argsort(place[self.text[mine]], kind="stable")]
        sentence = self.sentence[mine]
        starts = np.r_[True, sentence[1:] != sentence[:-1]] if len(mine) else np.empty(0, bool)
        return Texts(self.word[mine], place[self.text[mine]], np.cumsum(starts) - 1, self.commas[texts])


def _quantiles(values: np.ndarray, group: np.ndarray, groups: int, at: tuple = (0.1, 0.25, 0.5, 0.75, 0.9)) -> np.ndarray:
    """Linearly interpolated quantiles of each group's values, one column for each; zeros for a group without values."""
    out = np.zeros((groups, len(at)))
    if not len(values):
        return out
    n = np.bincount(group, minlength=groups)
    low = values.min()
    wide = values.max() - low + 1.0
    ordered = np.sort(group * wide + (values - low)) - np.repeat(np.arange(groups), n) * wide + low
    first, some = np.cumsum(n) - n, n > 0
    for j, q in enumerate(at):
        place = q * (n[some] - 1)
        k = place.astype(np.int64)
        a, b = ordered[first[some] + k], ordered[first[some] + np.minimum(k + 1, n[some] - 1)]
        out[some, j] = a + (b - a) * (place - k)
    return out


def _means(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(group, weights=values, minlength=groups) / np.maximum(np.bincount(group, minlength=groups), 1)


def language(t: Texts, words: Words) -> list[str]:
    """The language whose function words make up most of each text; '' if none does."""
    table = words.known()
    score = np.stack([np.bincount(t.text, weights=table[t.word, 4 + i], minlength=len(t.commas)) for i in range(len(_LANGUAGES))], axis=1)
    return [_LANGUAGES[k] if s > 0 else "" for k, s in zip(score.argmax(axis=1), score.max(axis=1), strict=True)]


def features(t: Texts, words: Words, level_of: np.ndarray, middle: float) -> np.ndarray:
    """The feature vectors of texts; zeros for one without words. level_of: mean level by word number, NaN for unknown words, which count as middle."""
    groups = len(t.commas)
    n = t.count()
    out = np.zeros((groups, N_FEATURES))
    if not len(t.word):
        return out
    table = words.known()
    length, syllables, small, link = (table[t.word, i] for i in range(4))
    level = level_of[t.word]
    known = ~np.isnan(level)
    level = np.where(known, level, middle)

    # Windows of SPAN words, a half apart, over each text.
    half = SPAN // 2
    first = np.cumsum(n) - n
    windows = np.where(n > 0, np.maximum(1, -(-(n - half) // half)), 0)
    of = np.repeat(np.arange(groups), windows)
    k = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = first[of] + k * half
    ends = np.minimum(starts + SPAN, first[of] + n[of])

    def span(x: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(x)])
        return (upto[ends] - upto[starts]) / (ends - starts)

    # Cohesion: content words that a window shares with the window after it (two on, as neighbours overlap).
    size = ends - starts
    inside = np.repeat(np.arange(len(of)), size)
    at = np.repeat(starts, size) + np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    content = small[at] == 0
    many = len(words.words)
    pairs = np.unique(inside[content] * many + t.word[at[content]])
    window = pairs // many
    kinds = np.bincount(window, minlength=len(of))
    follows = np.r_[of[2:] == of[:-2], False, False] if len(of) > 2 else np.zeros(len(of), bool)
    shared = pairs[np.isin(pairs + 2 * many, pairs, assume_unique=True) & follows[window]] // many
    common = np.bincount(shared, minlength=len(of))
    pair = np.flatnonzero(follows)
    cohesion = common[pair] / np.maximum(1, np.minimum(kinds[pair], kinds[pair + 2]))

    per_sentence = np.bincount(t.sentence).astype(float)
    sentence_of = t.text[np.r_[True, t.sentence[1:] != t.sentence[:-1]]]
    links = np.bincount(t.sentence, weights=link)
    safe = np.maximum(n, 1)
    kinds_of_text = np.bincount(np.unique(t.text * many + t.word) // many, minlength=groups)
    has_known = np.bincount(t.text[known], minlength=groups)
    quarters = (0.25, 0.5, 0.75)
    columns = [
        _quantiles(span(level), of, groups), _quantiles(span(length), of, groups), _quantiles(span((syllables >= 3).astype(float)), of, groups), _quantiles(span(small), of, groups, quarters),
        _quantiles(per_sentence, sentence_of, groups), _quantiles(links, sentence_of, groups, (0.5, 0.9)), _quantiles(cohesion, of[pair], groups, quarters),
        _quantiles(length, t.text, groups, (0.5, 0.75, 0.9)), _quantiles(level, t.text, groups, (0.1, 0.5, 0.75, 0.9)),
        np.where(has_known > 0, np.bincount(t.text[known], weights=level[known], minlength=groups) / np.maximum(has_known, 1), middle), has_known / safe, np.log1p(n), kinds_of_text / safe, kinds_of_text / np.sqrt(safe),
        t.commas / safe, np.bincount(t.text, weights=link, minlength=groups) / safe, _means(cohesion, of[pair], groups), _means(per_sentence, sentence_of, groups), _means(syllables, t.text, groups),
        _means((length >= 9).astype(float), t.text, groups), _means((length <= 3).astype(float), t.text, groups),
    ]
    out[:] = np.column_stack(columns)
    out[n == 0] = 0.0
    return out


N_FEATURES = 5 + 5 + 5 + 3 + 5 + 2 + 3 + 3 + 4 + 12


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on binned features: per tree, split feature and bin of each inner node and the values of its leaves."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows, out = np.arange(len(b)), np.full(len(b), self.base)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 160, depth: int = 3, rate: float = 0.08, least: int = 4, bins: int = 32, sample: float = 0.8, seed: int = 7) -> Trees:
    """Least-squares gradient boosting with histogram splits. Without rows the model is the middle level."""
    if not len(y):
        none = np.zeros((0, 2**depth - 1), np.int64)
        return Trees([np.empty(0)] * x.shape[1], 3.0, none, none, np.zeros((0, 2**depth)), depth)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Trees(edges, float(y.mean()), np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 255, np.int64), np.zeros((trees, 2**depth)), depth)
    b, n_feat = model.binned(x).astype(np.int64), x.shape[1]
    flat = b + np.arange(n_feat) * bins
    now, rows = np.full(len(y), model.base), np.arange(len(y))
    for t in range(trees):
        rest = y - now
        used = rng.random(len(y)) < sample if len(y) > 20 else np.ones(len(y), bool)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = used & (node == k)
                n = int(at.sum())
                if n < 2 * least:
                    continue
                count = np.bincount(flat[at].ravel(), minlength=n_feat * bins).reshape(n_feat, bins).cumsum(1)
                total = np.bincount(flat[at].ravel(), weights=np.repeat(rest[at], n_feat), minlength=n_feat * bins).reshape(n_feat, bins).cumsum(1)
                left, right = count, n - count
                gain = np.where((left >= least) & (right >= least), total**2 / np.maximum(left, 1) + (total[:, -1:] - total) ** 2 / np.maximum(right, 1), -np.inf)
                best = int(gain.argmax())
                if np.isfinite(gain.flat[best]):
                    model.feature[t, k], model.cut[t, k] = divmod(best, bins)
            node = 2 * node + 1 + (b[rows, model.feature[t][node]] > model.cut[t][node])
        at = node - (2**depth - 1)
        sums, counts = np.bincount(at[used], weights=rest[used], minlength=2**depth), np.bincount(at[used], minlength=2**depth)
        model.leaf[t] = rate * sums / (counts + 1.0)
        now += model.leaf[t][at]
    return model


def vocabulary_of(t: Texts, levels: np.ndarray, words: Words, weight: float = 2.0, least: int = 2) -> tuple[dict[str, float], float]:
    """Mean level of the texts each word stands in, drawn to the overall mean; words of fewer texts than least are left out."""
    middle = float(levels.mean()) if len(levels) else 3.0
    many = len(words.words)
    pairs = np.unique(t.text * many + t.word)
    word, level = pairs % many, levels[pairs // many] if len(pairs) else np.empty(0)
    n, total = np.bincount(word, minlength=many), np.bincount(word, weights=level, minlength=many)
    return {words.words[k]: (total[k] + weight * middle) / (n[k] + weight) for k in np.flatnonzero(n >= least)}, middle


def isotonic(grade: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (grade, expected level) of the rising step function nearest to the levels, by pooling neighbours that are out of order."""
    order = np.argsort(grade, kind="stable")
    blocks: list[list[float]] = []  # sum of levels, of grades, count
    for g, y in zip(grade[order], level[order], strict=True):
        blocks.append([float(y), float(g), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([g / n for _, g, n in blocks]), np.array([y / n for y, _, n in blocks])


@dataclass
class ReadingModel:
    vocabulary: dict[str, float]
    middle: float
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]
    held_out: pd.DataFrame  # doc_id, source, level, and grade of the folds' held-out texts, calibrated on the other folds

    def grades(self, texts: list[str | None]) -> np.ndarray:
        words = Words()
        t = Texts.of(texts, words)
        return calibrated(self.trees.predict(features(t, words, words.levels(self.vocabulary), self.middle)), self.knots) if len(texts) else np.empty(0)


def calibrated(grade: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Grades on the scale of the levels; as they are without knots."""
    return np.interp(grade, *knots) if len(knots[0]) else grade


def level_of_grade(grade: np.ndarray, levels: int = 5) -> np.ndarray:
    return np.clip(np.floor(grade + 0.5), 1, levels).astype(int)


@dataclass
class Sample:
    """Labelled texts in flat form, and their features under the vocabulary of chosen texts."""

    texts: Texts
    words: Words
    level: np.ndarray

    def vocabulary(self, rows: np.ndarray) -> tuple[dict[str, float], float]:
        part = self.texts.take(rows)
        return vocabulary_of(part, self.level[rows], self.words)

    def encoded(self, rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Features of rows, words scored by the labels of by."""
        vocabulary, middle = self.vocabulary(by)
        return features(self.texts.take(rows), self.words, self.words.levels(vocabulary), middle)


def held_out_grades(sample: Sample, fold: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """A grade of every text from a model that saw no label of the text's outer group.

    The model's own texts are scored, fold by fold, by labels of the other folds and outside the outer group.
    """
    grade = np.full(len(outer), sample.level.mean() if len(outer) else 3.0)
    for k in np.unique(outer):
        mine, rest = np.flatnonzero(outer == k), np.flatnonzero(outer != k)
        if not len(rest):
            continue
        x = np.zeros((len(rest), N_FEATURES))
        for j in np.unique(fold[rest]):
            at = np.flatnonzero(fold[rest] == j)
            by = rest[fold[rest] != j]
            x[at] = sample.encoded(rest[at], by if len(by) else rest)
        grade[mine] = boost(x, sample.level[rest]).predict(sample.encoded(mine, rest))
    return grade


def _prepared(sample: pd.DataFrame, folds: int) -> tuple[pd.DataFrame, Sample, np.ndarray]:
    sample = sample.sort_values("doc_id", kind="stable").reset_index(drop=True)
    words = Words()
    made = Sample(Texts.of(list(sample["text"]), words), words, sample["level"].to_numpy(float))
    # Folds are dealt by level and source in turn, so that each holds of every one.
    order = sample.assign(source=sample["source"].fillna("")).sort_values(["level", "source", "doc_id"], kind="stable").index.to_numpy()
    fold = np.empty(len(sample), int)
    fold[order] = np.arange(len(sample)) % folds
    return sample, made, fold


def fit(sample: pd.DataFrame, folds: int = FOLDS) -> ReadingModel:
    """Fit on labelled texts (doc_id, source, text, level), sorted by doc_id for the same result in any order."""
    sample, made, fold = _prepared(sample, folds)
    grade = held_out_grades(made, fold, fold)
    every = np.arange(len(sample))
    x = np.zeros((len(sample), N_FEATURES))
    for k in np.unique(fold):
        x[fold == k] = made.encoded(every[fold == k], every[fold != k])
    honest = np.empty(len(sample))
    for k in np.unique(fold):
        honest[fold == k] = calibrated(grade[fold == k], isotonic(grade[fold != k], made.level[fold != k]))
    vocabulary, middle = made.vocabulary(every)
    return ReadingModel(vocabulary, middle, boost(x, made.level), isotonic(grade, made.level), sample[["doc_id", "source", "level"]].assign(grade=honest))


def by_source(sample: pd.DataFrame, folds: int = FOLDS) -> pd.DataFrame:
    """doc_id, source, level and grade of labelled texts, each graded and calibrated without a label of its own source; few sources, so a model each."""
    sample, made, fold = _prepared(sample, folds)
    names, outer = np.unique(sample["source"].fillna("?").to_numpy(str), return_inverse=True)
    raw = held_out_grades(made, fold, outer)
    grade = np.empty(len(sample))
    for k in range(len(names)):
        grade[outer == k] = calibrated(raw[outer == k], isotonic(raw[outer != k], made.level[outer != k]))
    return sample[["doc_id", "level"]].assign(source=names[outer] if len(names) else [], grade=grade)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> pd.DataFrame:
    """At most `most` labelled documents with their texts, chosen by a hash of doc_id; repeated labels count once (the least level)."""
    one = labels.where("doc_id is not null and level between 1 and 5").groupBy("doc_id").agg(F.min("level").alias("level"))
    both = docs.select("doc_id", source_name("source").alias("source"), "text").join(one, "doc_id").where("text is not null")
    return both.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).dropDuplicates(["doc_id"]).toPandas()


def graded(docs: DataFrame, model: ReadingModel) -> DataFrame:
    """(doc_id, grade, level, language) of every document. A null text or one without words gets null grade and level."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade double, level int, language string"
    vocabulary, middle, trees, knots = model.vocabulary, model.middle, model.trees, model.knots  # sized by the labelled sample; sent with the function

    def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= CHUNK:
                yield part
                part, size = [], 0
        if part:
            yield part

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, levels = Words(), np.empty(0)
        for b in batches:
            done, lang = [], []
            for texts in chunks(b.column(1).to_pylist()):
                if len(words.words) > 500_000:  # of this worker only
                    words, levels = Words(), np.empty(0)
                t = Texts.of(texts, words)
                levels = np.concatenate([levels, [vocabulary.get(w, np.nan) for w in words.words[len(levels) :]]])
                g = calibrated(trees.predict(features(t, words, levels, middle)), knots)
                done.append(np.where(t.count() > 0, g, np.nan))
                lang += language(t, words)
            g = np.concatenate(done) if done else np.empty(0)
            none = np.isnan(g)
            level = pa.array(level_of_grade(np.where(none, 1.0, g)), pa.int32(), mask=none)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(g, pa.float64(), mask=none), level, pa.array(lang, pa.string())], names=["doc_id", "grade", "level", "language"])

    return docs.select("doc_id", "text").mapInArrow(grade, schema)


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pd.DataFrame]:
    docs = read(spark, sf_dir, "documents")
    return docs, labelled_sample(docs, read(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sample = _sample(spark, sf_dir)
    wanted = docs.where(F.length("text") >= 300).join(read(spark, sf_dir, "reading_labels").select("doc_id").distinct(), "doc_id", "left_anti")
    return graded(wanted, fit(sample)).where("language = 'en' and level is not null").select("doc_id", "level")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade and level of every document, whatever its length and language."""
    docs, sample = _sample(spark, sf_dir)
    return graded(docs, fit(sample))


def p8_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and error on the labelled sample by source: texts held out by folds, and whole sources held out."""
    _, sample = _sample(spark, sf_dir)

    def report(held: pd.DataFrame, way: str) -> list[tuple]:
        right = level_of_grade(held["grade"].to_numpy()) == held["level"].to_numpy()
        by = held.assign(source=held["source"].fillna("?"), right=right, error=(held["grade"] - held["level"]).abs()).groupby("source").agg(n=("right", "size"), accuracy=("right", "mean"), mean_error=("error", "mean")).reset_index()
        return [(way, r.source, int(r.n), float(r.accuracy), float(r.mean_error)) for r in by.itertuples()]

    rows = [*report(fit(sample).held_out, "folds"), *report(by_source(sample), "sources")]
    return spark.createDataFrame(rows, "held_out string, source string, n long, accuracy double, mean_error double")


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_levels": p8_levels, "p8_accuracy": p8_accuracy}
