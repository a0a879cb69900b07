"""Matching entities across sources without keys.

Sorted neighbourhood over four composite sort keys (title, title backwards, an author and the year, venue and
year and an author).  All keys go through one range-partitioned sort; a window slides over the sorted
Arrow batches and compares 64-bit word signatures, and the rows at partition borders are compared across
the border afterwards, so the result does not depend on the partitioning.  Surviving pairs are scored by
weighted field similarities in Spark SQL, and a one-to-one assignment of maximal total confidence is found by an
auction over the records that have more than one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergekin.llm.p3_names import deletes
from mergekin.session import drop, read, stash
from mergekin.standardise import is_missing, plain, plain_or_null

#: Rows compared with each row's predecessors in every sort order.
WINDOW = 12
#: Pairs of less confidence are no match.
THRESHOLD = 0.7
#: A title of this many different years or more does not tell works apart; its year has to.
GENERIC_YEARS = 5
#: Field weights, and those of pairs with such a title.
WEIGHTS = {"title": 0.45, "authors": 0.25, "year": 0.15, "venue": 0.15}
GENERIC_WEIGHTS = {"title": 0.1, "authors": 0.35, "year": 0.4, "venue": 0.15}

#: Words that carry no initial in a venue's acronym.
_SMALL_WORDS = ["of", "the", "on", "and", "in", "for", "proc", "proceedings", "a"]
#: Words of a title that copies drop or shorten at will, and abbreviations that are no beginning of their word.
_LIGHT_WORDS = ["a", "an", "amp", "and", "the", "of", "on", "in", "for", "from", "to", "with", "w"]
_SHORT_FORMS = {"db": "database", "dbs": "databases", "kb": "knowledge", "mgmt": "management"}
_TITLE_WORDS = 4
_AUTHOR_WORDS = 2
_GRAM_WORDS = 4


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _bits(h: Column, words: int) -> list[Column]:
    """A set of hashes as a bitmap of that many longs."""

    def word(w: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
        return F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.when(F.pmod(F.shiftright(x, 6), F.lit(words)) == w, acc.bitwiseOR(bit(x))).otherwise(acc))

    return [word(w) for w in range(words)]


def venue_codes(pubs: DataFrame, venues: DataFrame) -> DataFrame:
    """(venue, code): the official venue's acronym for every written form; null where none is nearest.

    The acronym of a written name is its words' initials, of which the official one may differ by one letter.
    """

    def initials(c: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(plain(c), r"\d+", ""), " "), lambda w: (w != "") & ~w.isin(_SMALL_WORDS))
        joined = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
        first = F.element_at(words, 1)
        tail = F.element_at(words, -1)
        trimmed = F.array_join(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.substring(w, 1, 1)), "")
        return F.when(F.size(words) == 0, None).when(F.size(words) == 1, first).when(tail == trimmed, trimmed).otherwise(joined)

    official = venues.select(initials(F.col("venue_name")).alias("official")).where("official is not null").distinct().withColumn("d", F.explode_outer(deletes(F.col("official"))))
    written = pubs.select("venue").where(~is_missing("venue")).distinct().withColumn("given", initials(F.col("venue"))).where("given is not null").withColumn("d", F.explode_outer(deletes(F.col("given"))))
    near = written.join(official, "d").where(F.levenshtein("given", "official", 1) >= 0).select("venue", "given", "official").distinct()
    best = near.groupBy("venue").agg(F.max(F.when(F.col("given") == F.col("official"), F.col("official"))).alias("same"), F.count("*").alias("n"), F.max("official").alias("one"))
    return best.select("venue", F.when(F.col("same").isNotNull(), F.col("same")).when(F.col("n") == 1, F.col("one")).alias("code"))


def author_signatures(people: DataFrame) -> DataFrame:
    """One row per publication: bitmaps of its authors' name words and letter pairs, and two sort keys. Of bounded size, however many authors it has."""
    words = F.filter(F.split(plain(F.regexp_replace("fullname", r"&\w+;", " ")), " "), lambda w: F.length(w) > 1)
    # Names without words stay in: a condition on the words would form them twice.
    rows = people.where("pub_id is not null and fullname is not null").select("pub_id", words.alias("w"))
    longest = F.array_max(F.transform("w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).getField("w")
    grams = F.flatten(F.transform("w", lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    bits = [c.alias(f"a{i}") for i, c in enumerate(_bits(F.col("hw"), _AUTHOR_WORDS))] + [c.alias(f"g{i}") for i, c in enumerate(_bits(F.col("hg"), _GRAM_WORDS))]
    rows = rows.select("pub_id", longest.alias("key"), _hashes(F.col("w")).alias("hw"), _hashes(grams).alias("hg")).select("pub_id", "key", *bits)
    ors = [F.bit_or(c).alias(c) for c in [*(f"a{i}" for i in range(_AUTHOR_WORDS)), *(f"g{i}" for i in range(_GRAM_WORDS))]]
    return rows.groupBy("pub_id").agg(F.min("key").alias("first_author"), F.max("key").alias("last_author"), *ors)


def prepared(pubs: DataFrame, people: DataFrame, venues: DataFrame) -> DataFrame:
    """One row per delivered publication row with everything that keys and scores need."""
    title = plain_or_null("pub_name")
    short = F.create_map(*[F.lit(x) for pair in _SHORT_FORMS.items() for x in pair])
    words = F.transform(F.filter(F.split(title, " "), lambda w: (w != "") & ~w.isin(_LIGHT_WORDS)), lambda w: F.coalesce(short[w], w))
    base = pubs.where("id is not null and source in ('A', 'B')").select(
        "id", (F.col("source") == "A").alias("is_a"), F.coalesce("origin_id", -F.col("id") - 1).alias("rec"),
        F.when(F.col("year") > 0, F.col("year")).alias("year"), "venue", F.coalesce(words, F.array().cast("array<string>")).alias("words"),
    )
    base = base.join(venue_codes(pubs, venues), "venue", "left").drop("venue")
    base = base.join(author_signatures(people).withColumnRenamed("pub_id", "id"), "id", "left")
    base = base.withColumn("hashes", _hashes(F.col("words")))
    return base.withColumns({f"t{i}": c for i, c in enumerate(_bits(F.col("hashes"), _TITLE_WORDS))}).drop("hashes")


def _payload() -> list[str]:
    return ["id", "is_a", "year", "code_no", *(f"t{i}" for i in range(_TITLE_WORDS)), *(f"a{i}" for i in range(_AUTHOR_WORDS))]


def _keyed(rows: DataFrame) -> DataFrame:
    flat = F.array_join("words", "")
    year = F.coalesce(F.col("year").cast("string"), F.lit("?"))
    none = F.lit("")
    first, last, code = F.coalesce("first_author", none), F.coalesce("last_author", none), F.coalesce("code", none)
    # Every key ends in all that rows are compared by, so a run of equal keys, however long, holds rows that can stand for each other.
    keys = [
        F.when(flat != "", F.concat_ws("|", flat, first, year, code, last)),
        F.when(flat != "", F.concat_ws("|", F.reverse(flat), year, code, first, last)),
        F.when(first != "", F.concat_ws("|", first, year, flat, code, last)),
        F.when(code != "", F.concat_ws("|", code, year, last, flat, first)),
    ]
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("kno"), k.alias("key")) for i, k in enumerate(keys)]))
    zero = F.lit(0).cast("long")
    bits = [F.coalesce(c, zero).alias(c) for c in _payload() if c[1:].isdigit()]
    code_no = F.when(F.col("code").isNull(), 0).otherwise(F.xxhash64("code")).alias("code_no")
    return rows.select(named.alias("k"), "id", "is_a", F.coalesce("year", F.lit(0)).alias("year"), code_no, *bits).select("k.kno", "k.key", *_payload()).where("key is not null")


def _likely(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows i, j are worth scoring: enough common words in titles and in author names."""

    def overlap(prefix: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        both = sum(np.bitwise_count(x[f"{prefix}{k}"][i] & x[f"{prefix}{k}"][j]).astype(np.int32) for k in range(n))
        least = np.minimum(x[f"{prefix}n"][i], x[f"{prefix}n"][j])
        return both / np.maximum(least, 1), least > 0

    t, has_t = overlap("t", _TITLE_WORDS)
    a, has_a = overlap("a", _AUTHOR_WORDS)
    same_year = (x["year"][i] == x["year"][j]) & (x["year"][i] > 0)
    venue_ok = (x["code_no"][i] == x["code_no"][j]) | (x["code_no"][i] == 0) | (x["code_no"][j] == 0)
    return (
        (has_t & has_a & (((t >= 0.6) & (a >= 0.3)) | ((t >= 0.3) & (a >= 0.6))))
        | (has_t & (t >= 0.85) & (~has_a | (a >= 0.2) | same_year))
        | (~has_t & has_a & (a >= 0.6) & same_year & venue_ok)
    )


def _columns(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    for p, n in (("t", _TITLE_WORDS), ("a", _AUTHOR_WORDS)):
        cols[f"{p}n"] = sum(np.bitwise_count(cols[f"{p}{k}"].view(np.uint64)).astype(np.int32) for k in range(n))
        for k in range(n):
            cols[f"{p}{k}"] = cols[f"{p}{k}"].view(np.uint64)
    return cols


def _compare(x: dict[str, np.ndarray], fresh: int, window: int, pos: np.ndarray | None = None, part: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of likely cross-source pairs between rows at most window apart, the later one at or after index fresh; with pos, of different parts and the later one own."""
    n, left, right = len(x["id"]), [], []
    for k in range(1, window + 1):
        i = np.arange(max(fresh, k), n)
        if not len(i):
            continue
        j = i - k
        ok = (x["is_a"][i] != x["is_a"][j]) & (x["kno"][i] == x["kno"][j])
        if pos is not None:
            ok &= (pos[i] - pos[j] <= window) & (part[i] != part[j]) & own[i]
        i, j = i[ok], j[ok]
        good = _likely(x, i, j)
        left.append(x["id"][i[good]])
        right.append(x["id"][j[good]])
    e = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (e, e)


def _slider(window: int):
    names = ["kno", *_payload()]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("last", pa.bool_()), ("kno", pa.int32()), *((c, pa.bool_() if c == "is_a" else pa.int64()) for c in _payload())])

        def border(x: dict, at: np.ndarray, pos: np.ndarray, last: bool) -> pa.RecordBatch:
            n = len(at)
            none = pa.nulls(n, pa.int64())
            own = [pa.array(x[c][at].astype(np.int32) if c == "kno" else x[c][at].view(np.int64) if x[c].dtype == np.uint64 else x[c][at] if c == "is_a" else x[c][at].astype(np.int64)) for c in names]
            return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(n, part, np.int32)), pa.array(pos), pa.array(np.full(n, last)), *own], schema=schema)

        seen, carry = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names}
            got = _columns({c: np.ascontiguousarray(v) for c, v in got.items()})
            n = batch.num_rows
            head = np.arange(max(0, min(n, window - seen)))
            if len(head):
                yield border(got, head, seen + head, False)
            x = got if carry is None else {c: np.concatenate([carry[c], got[c]]) for c in got}
            fresh = len(x["id"]) - n
            a, b = _compare(x, fresh, window)
            if len(a):
                a, b = np.minimum(a, b), np.maximum(a, b)
                none = [pa.nulls(len(a), f.type) for f in list(schema)[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], schema=schema)
            seen += n
            carry = {c: v[-window:] for c, v in x.items()}
        if carry is not None:
            k = len(carry["id"])
            yield border(carry, np.arange(k), np.arange(seen - k, seen), True)

    return slide


def _across(window: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["place", "own"]).sort_values("place", kind="stable")
        x = {c: np.ascontiguousarray(pdf[c].to_numpy(bool if c == "is_a" else np.int64)) for c in ["kno", *_payload()]}
        a, b = _compare(_columns(x), 0, window, pdf["place"].to_numpy(), pdf["part"].to_numpy(), pdf["own"].to_numpy(bool))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return compare


def neighbourhood_pairs(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (a, b), a < b: ids of likely cross-source pairs that stand within the window in some sort order.

    Rows of equal keys lie in the order of a hash, so those of the two sources are mixed.
    """
    fields = ", ".join(f"{c} {'boolean' if c == 'is_a' else 'long'}" for c in _payload())
    entries = _keyed(rows).withColumns({"year": F.col("year").cast("long"), "tie": F.xxhash64("id")})
    ordered = entries.repartitionByRange("kno", "key", "tie").sortWithinPartitions("kno", "key", "tie").drop("key", "tie")
    found = stash(ordered.mapInArrow(_slider(window), f"a long, b long, part int, pos long, last boolean, kno int, {fields}"), "window")
    # Border rows get their place in the whole order and meet in blocks of one window's width and the block before: a few rows a task's group.
    borders = found.where("a is null")
    sizes = borders.groupBy("part").agg((F.max("pos") + 1).alias("n"))  # one row for each partition of the sort
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    placed = borders.join(starts, "part").withColumn("place", F.col("pos") + F.col("start")).withColumn("block", F.floor(F.col("place") / window))
    shown = placed.withColumn("own", F.lit(True)).unionByName(placed.withColumns({"block": F.col("block") + 1, "own": F.lit(False)}))
    met = shown.groupBy("block").applyInPandas(_across(window), "a long, b long")
    return found.where("a is not null").select("a", "b").unionByName(met).distinct()


def _count_bits(prefix: str, n: int, x: str, y: str | None = None) -> Column:
    total = F.lit(0)
    for k in range(n):
        c = F.coalesce(F.col(f"{x}.{prefix}{k}"), F.lit(0).cast("long"))
        total = total + F.bit_count(c if y is None else c.bitwiseAND(F.coalesce(F.col(f"{y}.{prefix}{k}"), F.lit(0).cast("long"))))
    return total


def _set_likeness(prefix: str, n: int) -> Column:
    least = F.least(_count_bits(prefix, n, "x"), _count_bits(prefix, n, "y"))
    return F.when(least > 0, _count_bits(prefix, n, "x", "y") / least)


def _near_word(x: Column, y: Column) -> Column:
    """Same word but for a slip, or one abbreviates the other. Numbers and short words have to be equal."""
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    letters = ~x.rlike(r"^\d+$") & ~y.rlike(r"^\d+$")
    slip = (short >= 4) & F.levenshtein(x, y, 3).between(0, F.when(long_ >= 9, 3).when(long_ >= 6, 2).otherwise(1))
    cut = (short >= 2) & (long_ >= 4) & (F.startswith(x, y) | F.startswith(y, x))
    return letters & (slip | cut)


def with_title_likeness(pairs: DataFrame, x: str, y: str, name: str = "title") -> DataFrame:
    """pairs with the likeness of two titles given as arrays of plain words, null if either is empty.

    Words left on both sides after equal, misspelt and abbreviated ones are paired mark different works (parts,
    subtitles) and weigh most; words missing on one side weigh less; joined, split or cut-off titles are compared by letter.
    Every step is a column of its own, as the steps are used several times; equal titles skip them.
    """
    x, y = F.col(x), F.col(y)
    fx, fy, la, lb, nu, nv = (F.col(c) for c in ("_fx", "_fy", "_la", "_lb", "_nu", "_nv"))
    numbers_of = lambda w: F.array_sort(F.filter(w, lambda t: t.rlike(r"^(\d+|[ivx]+)$")))
    out = pairs.withColumns({"_fx": F.array_join(x, ""), "_fy": F.array_join(y, "")})
    differ = fx != fy
    out = out.withColumns({"_la": F.when(differ, F.array_except(x, y)), "_lb": F.when(differ, F.array_except(y, x))})
    out = out.withColumns({
        "_nu": F.when(differ, F.size(F.filter(la, lambda w: ~F.exists(lb, lambda v: _near_word(w, v))))), "_nv": F.when(differ, F.size(F.filter(lb, lambda w: ~F.exists(la, lambda v: _near_word(w, v))))),
        "_same_numbers": F.when(differ, numbers_of(la) == numbers_of(lb)),
    })
    both, extra = F.least(nu, nv), F.abs(nu - nv)
    by_words = 1 - (1.5 * both + 0.5 * extra) / ((F.size(x) + F.size(y)) / 2.0) - F.when(both > 0, 0.25).otherwise(0.0)
    long = F.least(F.length(fx), F.length(fy)) >= 12
    glued = F.col("_same_numbers") & (F.levenshtein(fx, fy, 3) >= 0) & long & ((F.size(x) != F.size(y)) | (both == 0))
    cut = F.col("_same_numbers") & long & (F.startswith(fx, fy) | F.startswith(fy, fx)) & (F.abs(F.size(x) - F.size(y)) > 1)
    likeness = F.when(~differ, 1.0).when(glued, 0.97).when(cut, F.greatest(by_words, F.lit(0.85))).otherwise(F.greatest(by_words, F.lit(0.0)))
    return out.withColumn(name, F.when((F.size(x) > 0) & (F.size(y) > 0), likeness)).drop("_fx", "_fy", "_la", "_lb", "_nu", "_nv", "_same_numbers")


def year_likeness(x: Column, y: Column) -> Column:
    sx, sy = x.cast("string"), y.cast("string")
    swapped = (F.array_sort(F.split(sx, "")) == F.array_sort(F.split(sy, "")))
    digit = F.levenshtein(sx, sy) == 1
    return F.when(x.isNull() | y.isNull(), None).when(x == y, 1.0).when(swapped | (digit & (F.abs(x - y) > 2)), 0.5).when(F.abs(x - y) <= 2, 0.3).otherwise(0.0)


def scored_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a_rec, b_rec, confidence): of every pair of source records the best confidence of its deliveries' pairs."""
    flat = F.array_join("words", "").alias("flat")
    titled = rows.where("size(words) > 0").select(flat, "year").distinct()
    generic = titled.groupBy("flat").agg(F.count("year").alias("n")).where(F.col("n") >= GENERIC_YEARS).select("flat", F.lit(True).alias("generic"))
    cols = ["is_a", "rec", "year", "code", "words", *(f"a{i}" for i in range(_AUTHOR_WORDS)), *(f"g{i}" for i in range(_GRAM_WORDS))]
    side = rows.dropDuplicates(["id"]).select("id", F.struct(*cols).alias("r"))
    both = pairs.join(side.withColumnsRenamed({"id": "a", "r": "x"}), "a").join(side.withColumnsRenamed({"id": "b", "r": "y"}), "b")
    both = both.withColumn("flat", F.array_join("x.words", "")).join(generic, "flat", "left")
    both = with_title_likeness(both, "x.words", "y.words")
    authors = (_set_likeness("a", _AUTHOR_WORDS) + F.pow(_set_likeness("g", _GRAM_WORDS), 2)) / 2
    venue = F.when(F.col("x.code").isNotNull() & F.col("y.code").isNotNull(), (F.col("x.code") == F.col("y.code")).cast("double"))
    # Columns recur under one title every few years, so there only the very year counts.
    years = year_likeness(F.col("x.year"), F.col("y.year"))
    both = both.select(F.col("x.is_a").alias("x_is_a"), F.col("x.rec").alias("x_rec"), F.col("y.rec").alias("y_rec"), "generic", "title", authors.alias("authors"), years.alias("year"), venue.alias("venue"))
    both = both.withColumn("generic", F.coalesce(F.col("generic") & (F.col("title") >= 0.8), F.lit(False)))
    both = both.withColumn("year", F.when(F.col("generic") & (F.col("year") < 1), 0.0).otherwise(F.col("year")))
    weight = {f: F.when(F.col(f).isNull(), 0.0).when(F.col("generic"), GENERIC_WEIGHTS[f]).otherwise(w) for f, w in WEIGHTS.items()}
    total = sum(weight.values(), F.lit(0.0))
    mean = sum((weight[f] * F.coalesce(f, F.lit(0.0)) for f in WEIGHTS), F.lit(0.0)) / F.greatest(total, F.lit(1e-9))
    # What is missing gives no evidence: a little is taken off for it, and without a title the other three have to agree.
    mean = mean - 0.1 * (1 - total / sum(WEIGHTS.values())) - F.when(F.col("title").isNull(), 0.05).otherwise(0.0)
    # Another venue, above all with another year, marks the later version of a paper.
    mean = mean - F.when((F.col("venue") == 0) & (F.coalesce("year", F.lit(0.0)) < 1), 0.25).when(F.col("venue") == 0, 0.12).otherwise(0.0)
    out = both.select(F.when(F.col("x_is_a"), F.col("x_rec")).otherwise(F.col("y_rec")).alias("a_rec"), F.when(F.col("x_is_a"), F.col("y_rec")).otherwise(F.col("x_rec")).alias("b_rec"), mean.alias("confidence"))
    return out.groupBy("a_rec", "b_rec").agg(F.max("confidence").alias("confidence"))


def _two_best(net: DataFrame, order: Column) -> DataFrame:
    """(a_rec, m, second): the best offer of each left record and the net value of the next, 0 (stay single) if there is none."""
    ranked = net.select("a_rec", order.alias("o"), F.row_number().over(Window.partitionBy("a_rec").orderBy(F.desc("net"), "b_rec")).alias("rank")).where("rank <= 2")
    return ranked.groupBy("a_rec").agg(F.max("o").alias("m"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("o.net"))), F.lit(0.0)).alias("second"))


def assign(edges: DataFrame, epsilon: float = 0.01) -> DataFrame:
    """One-to-one subset of edges (a_rec, b_rec, confidence > 0) whose total confidence is within epsilon a record of the largest.

    Records with a single candidate on both sides are settled at once.  The others hold an auction: every
    unassigned left record bids for its best right record at current prices, each right record takes its highest bid.
    Ties go to the smaller id.  All state is keyed tables; rounds go on until nobody bids.
    """
    da = edges.groupBy("a_rec").agg(F.count("*").alias("da"))
    db = edges.groupBy("b_rec").agg(F.count("*").alias("db"))
    edges = stash(edges.join(da, "a_rec").join(db, "b_rec"), "edges")
    # an edge is settled if it is alone at both ends; others, with their ends, take part in the auction
    settled = edges.where("da = 1 and db = 1").select("a_rec", "b_rec", "confidence")
    open_ = stash(edges.where("da > 1 or db > 1").select("a_rec", "b_rec", "confidence"), "open")
    spark = edges.sparkSession
    held = spark.createDataFrame([], "b_rec long, a_rec long, price double")
    prices = held.select("b_rec", "price")
    while True:
        busy = held.where("a_rec is not null").select("a_rec")
        net = open_.join(busy, "a_rec", "left_anti").join(prices, "b_rec", "left").select("a_rec", "b_rec", (F.col("confidence") - F.coalesce("price", F.lit(0.0))).alias("net"), F.coalesce("price", F.lit(0.0)).alias("price"))
        order = F.struct("net", (-F.col("b_rec")).alias("tie"), "b_rec", "price")
        best = _two_best(net.where("net > 0"), order)
        bids = best.select("a_rec", F.col("m.b_rec").alias("b_rec"), (F.col("m.price") + F.col("m.net") - F.col("second") + epsilon).alias("bid"))
        won = bids.groupBy("b_rec").agg(F.max(F.struct("bid", (-F.col("a_rec")).alias("tie"), "a_rec")).alias("m")).select("b_rec", F.col("m.a_rec").alias("a_rec"), F.col("m.bid").alias("price"))
        won = stash(won, "bids")
        if won.isEmpty():
            break
        old, held = held, stash(held.join(won.select("b_rec"), "b_rec", "left_anti").unionByName(won), "held")
        drop(old)
        drop(won)
        prices = held.select("b_rec", "price")
    winners = held.select("a_rec", "b_rec").join(open_, ["a_rec", "b_rec"])
    return settled.unionByName(winners.select("a_rec", "b_rec", "confidence"))


def matched_works(pubs: DataFrame, people: DataFrame, venues: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """(id_1, id_2, confidence) of every pair of deliveries, one of each source, that are the same work.

    Titles, venues, years, authors may be null or missing; a row with neither title nor authors matches nothing.  Rows loaded
    twice count once; rows without id or of another source are left out; extra columns are ignored; empty tables give no rows.
    """
    rows = stash(prepared(pubs.select("id", "source", "origin_id", "year", "venue", "pub_name"), people.select("pub_id", "fullname"), venues.select("venue_name")), "works")
    edges = scored_pairs(neighbourhood_pairs(rows, window), rows).where(F.col("confidence") >= threshold)
    chosen = assign(stash(edges, "scored"))
    ids = rows.select("id", "is_a", "rec").distinct()
    out = chosen.join(ids.where("is_a").select(F.col("rec").alias("a_rec"), F.col("id").alias("a_id")), "a_rec")
    out = out.join(ids.where("not is_a").select(F.col("rec").alias("b_rec"), F.col("id").alias("b_id")), "b_rec")
    return out.select(F.least("a_id", "b_id").alias("id_1"), F.greatest("a_id", "b_id").alias("id_2"), "confidence")


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_works(read(spark, sf_dir, "publication_dict"), read(spark, sf_dir, "people_dict"), read(spark, sf_dir, "venues"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("id_1", "id_2")


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches}
