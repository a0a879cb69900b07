"""Variant spellings of names typed by people.

Tokens first: a symmetric-delete index (every token under the hashes of itself less one letter) finds the
spellings within a small edit distance without comparing all tokens, and given names are led back to the
names written out through nicknames, contractions and the same kind of index over the frequent names.
Then names: the best attested (surname, given name, middle name) combinations stand for persons, and every other
written form is aligned, token by token under the optimal assignment, with the persons whose surname is in its
neighbourhood.  A form that fits several persons about equally well stays by itself.  A surname that very many rows hold
is used to tell persons apart only where a name has no other.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from itertools import permutations
from math import perm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergekin.session import read, stash
from mergekin.standardise import census_code, census_text, is_missing, plain

#: Titles and suffixes that are no part of a name, and particles that come and go before a surname.
TITLES = ["dr", "prof", "mr", "mrs", "miss", "sir", "rev", "jr", "sr", "ii", "iii", "iv"]
PARTICLES = ["van", "von", "der", "den", "de", "di", "da", "del", "la", "le", "mac", "zu"]

#: Common short and pet forms of given names that no rule of spelling derives.
NICKNAMES = {
    "abby": "abigail", "al": "albert alexander", "alec": "alexander", "alex": "alexander alexei alejandro", "alyosha": "alexei",
    "andy": "andrew", "annie": "ann", "archie": "archibald", "art": "arthur", "artie": "arthur", "babs": "barbara", "bastian": "sebastian",
    "bea": "beatrice", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "benny": "benjamin", "bert": "albert gilbert herbert robert",
    "bess": "elizabeth", "bessie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert",
    "bobby": "robert", "carrie": "caroline", "cathy": "catherine", "charlie": "charles", "chris": "christopher christina", "chrissie": "christina",
    "chuck": "charles", "cindy": "lucinda", "connie": "constance", "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david",
    "debbie": "deborah", "dick": "richard", "dolly": "dorothy", "dora": "dorothy theodora", "dot": "dorothy", "drew": "andrew", "ed": "edward edmund",
    "eddie": "edward", "eliza": "elizabeth", "ellen": "helen eleanor", "ellie": "eleanor helen", "em": "emily", "emmy": "emily amelia", "fanny": "frances",
    "flo": "florence", "flossie": "florence", "fran": "frances francis", "franco": "francesco", "frank": "francis", "frankie": "francis frances",
    "fred": "frederick", "freddy": "frederick", "genie": "eugenia", "georgie": "george georgina", "gerrit": "gerardus", "gertie": "gertrude",
    "gianni": "giovanni", "gil": "gilbert", "griet": "grietje", "hal": "harold henry", "hank": "henry", "hanna": "johanna", "hans": "johannes",
    "harry": "henry harold", "hattie": "harriet", "henk": "hendrik", "hetty": "harriet esther", "ike": "isaac", "ina": "georgina", "izzy": "isabella",
    "jack": "john", "jake": "jacob", "jan": "johannes jane janet", "jandro": "alejandro", "janie": "jane", "jenny": "jane janet", "jess": "jessica",
    "jessie": "jessica janet", "jim": "james", "jimmy": "james", "jno": "john", "jo": "josephine johanna joseph", "joe": "joseph", "joey": "joseph",
    "johnny": "john", "jon": "jonathan", "josie": "josephine", "kate": "catherine katharina", "kathe": "katharina", "kathy": "katharina catherine",
    "kees": "cornelis", "kit": "christopher catherine", "kitty": "catherine", "larry": "lawrence", "laurie": "lawrence", "len": "leonard", "lena": "magdalena helena",
    "lenny": "leonard", "libby": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lottie": "charlotte", "lou": "louisa", "lucy": "lucinda lucia",
    "lulu": "louisa lucinda", "madge": "margaret", "magda": "magdalena", "maggie": "margaret", "mamie": "mary margaret", "marty": "martin martha", "matt": "matthew",
    "mati": "matilda", "mattie": "martha matilda", "maud": "matilda", "may": "mary", "meg": "margaret", "mick": "michael", "mike": "michael", "millie": "amelia emily", "mina": "wilhelmina",
    "minnie": "wilhelmina", "misha": "mikhail", "molly": "mary", "nacho": "ignacio", "nan": "ann agnes", "nancy": "ann", "nat": "nathaniel", "natasha": "nataliya",
    "nate": "nathaniel", "ned": "edward", "nell": "helen eleanor", "nellie": "helen eleanor", "nessie": "agnes", "nettie": "janet henrietta", "nick": "nicholas",
    "nora": "eleanor", "ollie": "oliver", "paddy": "patrick", "pat": "patrick", "patty": "martha", "peggy": "margaret", "pete": "peter", "phil": "philip",
    "piet": "pieter", "polly": "mary", "raj": "rajesh", "ray": "raymond", "reg": "reginald", "rick": "richard", "rika": "hendrika", "rob": "robert", "rosa": "rosanna",
    "rose": "rosanna", "rosie": "rosanna", "rudi": "rudolf", "sadie": "sarah", "sally": "sarah", "sam": "samuel", "sammy": "samuel", "sandy": "alexander",
    "seb": "sebastian", "steve": "stephen", "sue": "susannah", "susie": "susannah", "ted": "edward theodore", "terry": "theresa", "tess": "theresa",
    "theo": "theodore", "tilly": "matilda", "tim": "timothy", "tina": "christina", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "toon": "antonius",
    "tori": "victoria", "trina": "katharina catherine", "trixie": "beatrice", "trudy": "gertrude", "uschi": "ursula", "vicky": "victoria", "vince": "vincent",
    "wally": "walter", "walt": "walter", "will": "william", "wim": "willem", "zach": "zachary",
}

#: A surname held by more than this share of the rows, and by this many times the rows of a mean established one, stands for a person only
#: where the name has no other surname.
COMMON_SURNAME, COMMON_TIMES = 0.005, 20
#: A name in a given-name column counts as established at this share of the rows (at least 3 rows).
ESTABLISHED = 1 / 20000
#: An alignment has to reach this score, and beat the next person's by the margin.
ALIGN_AT, MARGIN = 0.55, 0.08
#: Among persons a form fits, one has to hold this share of their rows.
MOSTLY = 0.65


def fold(token: str) -> str:
    """Accents off, and the two-letter spellings of umlauts to one letter."""
    t = token if token.isascii() else "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))
    return t.replace("oe", "o").replace("ae", "a").replace("ue", "u")


def misread(token: str) -> str:
    """The token with rn as m, which scanners take for each other."""
    return token.replace("rn", "m")


def folded(token: Column) -> Column:
    """fold() as an expression."""
    plain_letters = F.translate(token, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    for pair, one in (("oe", "o"), ("ae", "a"), ("ue", "u")):
        plain_letters = F.replace(plain_letters, F.lit(pair), F.lit(one))
    return plain_letters


def deletes(token: Column) -> Column:
    """Hashes of the token and of the token less any one letter."""
    at = F.sequence(F.lit(1), F.length(token))
    less = F.transform(at, lambda i: F.xxhash64(F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(token)), less))


def close_tokens(f: Column, g: Column) -> Column:
    """Whether two folded tokens are within one edit, a swap of neighbours, or a scanner's rn for m."""
    swapped = (F.length(f) == F.length(g)) & (F.levenshtein(f, g, 2) >= 0) & (F.array_sort(F.split(f, "")) == F.array_sort(F.split(g, "")))
    read_as = (f.contains("rn") | g.contains("rn")) & (F.levenshtein(F.replace(f, F.lit("rn"), F.lit("m")), F.replace(g, F.lit("rn"), F.lit("m")), 1) >= 0)
    return (F.levenshtein(f, g, 1) >= 0) | swapped | read_as


def near_tokens(tokens: DataFrame, least: int = 4) -> DataFrame:
    """(token, near) pairs of different tokens, near the more frequent one, whose folded forms are close.

    tokens: (token, n), distinct.  Tokens shorter than least letters have no neighbours.  A bucket of the index holds the tokens that are
    one letter away from its key, so its size is bounded by length and alphabet, not by the rows.
    """
    m = F.replace(F.col("f"), F.lit("rn"), F.lit("m"))
    keys = F.when(F.col("f").contains("rn"), F.array_distinct(F.concat(deletes(F.col("f")), deletes(m)))).otherwise(deletes(F.col("f")))
    keyed = tokens.select("token", "n", folded(F.col("token")).alias("f")).where(F.length("f") >= least)
    # The folded form goes along where it differs; one exchange serves both sides of the join.
    keyed = keyed.select("token", "n", F.when(F.col("f") != F.col("token"), F.col("f")).alias("other"), keys.alias("ds")).select("token", "n", "other", F.explode_outer("ds").alias("d")).repartition("d")
    right = keyed.select(F.col("token").alias("near"), F.col("n").alias("near_n"), F.col("other").alias("near_other"), "d")
    # Of two tokens seen equally often, once each too, the first in order is the target.
    ahead = (F.col("near_n") > F.col("n")) | ((F.col("near_n") == F.col("n")) & (F.col("near") < F.col("token")))
    pairs = keyed.join(right, "d").where((F.col("token") != F.col("near")) & ahead)
    return pairs.where(close_tokens(F.coalesce("other", "token"), F.coalesce("near_other", "near"))).select("token", "near").distinct()


def _one_less(t: str) -> set[str]:
    return {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}


def edit_distance(a: str, b: str, most: int = 3) -> int:
    """Restricted Damerau distance; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if min(new) > most:
            return most + 1
        older, row = row, new
    return min(row[-1], most + 1)


def spelling_distance(a: str, b: str) -> int:
    """Edit distance up to 2 of folded tokens, taken as written or as a scanner may have misread them; 3 if it is larger."""
    if len(set(a) ^ set(b)) > 7:  # an edit changes two letters of the sets at most, a misread m three
        return 3
    d = edit_distance(a, b, 2)
    return min(d, edit_distance(misread(a), misread(b), 2)) if d > 1 and ("rn" in a or "rn" in b) else d


def contracts(short: str, full: str) -> bool:
    """Whether short is a beginning of full, or a contraction: same first and last letter and its letters in order."""
    if len(short) < 2 or len(full) - len(short) < 2 or short[0] != full[0]:
        return False
    if full.startswith(short):
        return True
    rest = iter(full)
    return short[-1] == full[-1] and all(c in rest for c in short)


class Contractions:
    """Finds the names that a short form contracts, by its beginning or by its first and last letter."""

    def __init__(self, names: list[str]):
        self.starts: dict[str, list[str]] = {}
        self.ends: dict[tuple[str, str], list[str]] = {}
        for u in names:
            for k in range(2, len(u) - 1):
                self.starts.setdefault(u[:k], []).append(u)
            if len(u) >= 4:
                self.ends.setdefault((u[0], u[-1]), []).append(u)

    def of(self, short: str) -> Iterator[str]:
        if len(short) >= 2:
            yield from self.starts.get(short, ())
            for u in self.ends.get((short[0], short[-1]), ()):
                if contracts(short, u):
                    yield u


class GivenNames:
    """Leads a written given name back to the established names it may stand for. frequent: name -> rows, a bounded lexicon."""

    def __init__(self, frequent: dict[str, int], nicknames: dict[str, str] = NICKNAMES):
        self.nicknames = nicknames
        self.full: dict[str, int] = {}
        near: dict[str, list[str]] = {}
        for t in frequent:
            for d in _one_less(t):
                near.setdefault(d, []).append(t)
        contractions = Contractions(list(frequent))
        for t, n in frequent.items():
            if t in nicknames or len(t) < 2:
                continue
            longer = len(t) <= 5 and any(frequent[u] >= 5 * n for u in contractions.of(t))
            slip = any(frequent[u] >= 20 * n and u != t and edit_distance(t, u, 1) <= 1 for d in _one_less(t) for u in near[d])
            if not longer and not slip:
                self.full[t] = n
        self.index: dict[str, set[str]] = {}
        for t in {*self.full, *(k for k in nicknames if len(k) > 3)}:
            for d in {e for x in _one_less(fold(t)) for e in (_one_less(x) if len(t) >= 7 else [x])}:
                self.index.setdefault(d, set()).add(t)
        self.unfold: dict[str, list[str]] = {}
        for t in self.full:
            self.unfold.setdefault(fold(t), []).append(t)
        self.short = Contractions(list(self.unfold))
        self.reachable = {*self.full, *(x for names in nicknames.values() for x in names.split())}
        self.known: dict[str, tuple[list[str], frozenset[str]]] = {}

    def both(self, token: str) -> tuple[list[str], frozenset[str]]:
        """The targets of a token as a list, most frequent first, and as a set."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 200_000:  # of this worker only; forgotten answers are found again
                self.known.clear()
            found = self._targets(token)
            got = self.known[token] = (found, frozenset(found))
        return got

    def targets(self, token: str) -> list[str]:
        return self.both(token)[0]

    def _targets(self, token: str) -> list[str]:
        if token in self.full:
            return [token]
        if token in self.nicknames:
            names = self.nicknames[token].split()
            return [x for x in names if x in self.full] or names
        if len(token) < 2:
            return []
        f = fold(token)
        found: dict[str, int] = {}
        if len(token) >= 3:
            near: set[str] = set()
            for g in {f, misread(f)}:
                near |= self.index.get(g, _NONE)
                for i in range(len(g)):
                    x = g[:i] + g[i + 1 :]
                    if x in self.index:
                        near |= self.index[x]
                    if len(f) >= 6:
                        for j in range(i, len(x)):
                            if (y := x[:j] + x[j + 1 :]) in self.index:
                                near |= self.index[y]
            for t in near:
                d = spelling_distance(f, fold(t))
                if d <= (2 if min(len(f), len(t)) >= 7 else 1):
                    for name in [t] if t in self.full else self.nicknames[t].split():
                        found[name] = min(d + (t not in self.full), found.get(name, 9))
        if f and (len(token) <= 6 or not found):
            for u in self.short.of(f):
                for t in self.unfold[u]:
                    found[t] = min(1, found.get(t, 9))
        if not found:
            return []
        least = min(found.values())
        return sorted((t for t, d in found.items() if d == least), key=lambda t: (-self.full.get(t, 0), t))


_NONE: frozenset[str] = frozenset()


def lexicon(counts: DataFrame, rows: int) -> tuple[dict[str, int], set[str], list[str]]:
    """Established given names with their rows, established surnames, and the common ones among these.

    Established is a token of at least ESTABLISHED of the rows, so there are at most a few times 1 / ESTABLISHED of them at any size.
    """
    floor = max(3, int(rows * ESTABLISHED))
    got = counts.where((F.length("token") > 1) & (F.greatest("as_given", "as_surname") >= floor)).select("token", "as_given", "as_surname").collect()
    given = {r.token: r.as_given for r in got if r.as_given >= floor and r.as_given > 2 * r.as_surname}
    surnames = {r.token for r in got if r.as_surname > r.as_given}
    mean = sum(r.as_surname for r in got if r.token in surnames) / max(1, len(surnames))
    return given, surnames, [r.token for r in got if r.as_surname > max(COMMON_SURNAME * rows, COMMON_TIMES * mean, r.as_given)]


class NameParser:
    """Splits a typed name into given names and a telling surname."""

    def __init__(self, given: GivenNames, surnames: set[str], common: list[str]):
        self.given, self.surnames, self.common = given, surnames, common
        self.ignored = {*TITLES, *PARTICLES}
        self.is_common: dict[str, bool] = {}

    def like_common(self, t: str) -> bool:
        got = self.is_common.get(t)
        if got is None:
            if len(self.is_common) > 200_000:
                self.is_common.clear()
            got = self.is_common[t] = any(t == c or (len(c) >= 5 and len(t) >= 3 and abs(len(c) - len(t)) <= 2 and edit_distance(t, c, 2) <= 2) for c in self.common)
        return got

    def parse(self, f: str, m: str, s: str) -> tuple[str, str, bool, str, str, str] | None:
        """(surname, given, loose, middle, tokens, first letters), or None if a part is lacking.

        Where a name has several surnames, those like a common one are left aside, unless all are.
        """
        g, others, given = [], [], self.given
        for text, col in ((f, 2), (m, 1), (s, 0)):
            for t in text.split():
                if t in self.ignored:
                    continue
                if len(t) == 1:
                    g.append((t, ()))
                elif t in self.surnames:
                    others.append((col, t))
                elif col == 0:
                    if t in given.full or t in given.nicknames:
                        g.append((t, given.both(t)[0]))
                    else:
                        others.append((col, t))
                elif targets := given.both(t)[0]:
                    g.append((t, targets))
                else:
                    others.append((col, t))
        if not g and len(others) > 1 and others[0][0] == 2 and others[0][1] not in self.surnames:
            g = [(others.pop(0)[1], ())]  # a given name beyond recognition
        if not g or not others:
            return None
        if len(others) > 1:
            others.sort(key=lambda o: o[0])
            others = [o for o in others if not self.like_common(o[1])] or others
        named = [t if len(t) == 1 or len(x) != 1 else x[0] for t, x in g]
        first, targets = g[0]
        letters = "".join({first[0], *(y[0] for _, x in g for y in x)})
        return others[0][1], named[0], len(first) == 1 or len(targets) != 1, named[1] if len(named) > 1 else "", " ".join([*(t for t, _ in g), *(t for _, t in others)]), letters


def best_total(m: list[list[float]]) -> float:
    """The largest sum of one entry a row, no two in one column; rows are no more than columns.

    Few choices are tried one by one, others go through the Hungarian method (shortest augmenting paths), so any number of tokens is exact.
    """
    k, n = len(m), len(m[0])
    if k == 1:
        return max(m[0])
    if k == 2 and n == 2:
        return max(m[0][0] + m[1][1], m[0][1] + m[1][0])
    if perm(n, k) <= 60:
        return max(sum(m[i][j] for i, j in enumerate(p)) for p in permutations(range(n), k))
    row_of, u, v = [-1] * n, [0.0] * k, [0.0] * n
    for r in range(k):
        slack, back, done, i, j0 = [float("inf")] * n, [-1] * n, [False] * n, r, -1
        while True:
            low, at = float("inf"), -1
            for j in range(n):
                if not done[j]:
                    cost = -m[i][j] - u[i] - v[j]
                    if cost < slack[j]:
                        slack[j], back[j] = cost, j0
                    if slack[j] < low:
                        low, at = slack[j], j
            u[r] += low
            for j in range(n):
                if done[j]:
                    u[row_of[j]] += low
                    v[j] -= low
                else:
                    slack[j] -= low
            done[at], j0 = True, at
            if row_of[at] < 0:
                break
            i = row_of[at]
        while j0 >= 0:
            before = back[j0]
            row_of[j0] = row_of[before] if before >= 0 else r
            j0 = before
    return sum(m[i][j] for j, i in enumerate(row_of) if i >= 0)


def token_likeness(x: str, y: str, led: Callable[[str, str], bool]) -> float:
    """Likeness of two tokens: equal 1, an initial 0.6, one led back to the other or to the same name (led) 0.92, a near spelling a little
    less, a beginning 0.75; two different tokens -0.8."""
    if x == y:
        return 1.0
    if len(x) == 1 or len(y) == 1:
        return 0.6 if x[0] == y[0] else -0.8
    if led(x, y):
        return 0.92
    fx, fy = fold(x), fold(y)
    least = min(len(fx), len(fy))
    if least >= 4:
        d = spelling_distance(fx, fy)
        if d <= (2 if least >= 7 else 1):
            return 0.95 - 0.12 * d
    if len(x) >= 3 and len(y) >= 3 and (y.startswith(x) or x.startswith(y)):
        return 0.75
    return -0.8


def align(a: list[str], b: list[str], like: Callable[[str, str], float]) -> float:
    """Score of the best assignment of name tokens a to tokens b, from 0 to 1; a token left over loses 0.15, as middle names are dropped at will."""
    if not a or not b:
        return 0.0
    m = [[like(x, y) for y in b] for x in a] if len(a) <= len(b) else [[like(x, y) for x in a] for y in b]
    k, n = len(m), len(m[0])
    return max(0.0, (best_total(m) - 0.15 * (n - k)) / k)


class Aligner:
    """Aligns names under one lexicon, remembering the likeness of token pairs. both: whether tokens of the second name are led back too."""

    def __init__(self, names: GivenNames, both: bool):
        self.names, self.two, self.seen = names, both, {}

    def led(self, x: str, y: str) -> bool:
        if not self.two:
            return y in self.names.reachable and y in self.names.both(x)[1]
        tx, ty = self.names.both(x)[1], self.names.both(y)[1]
        return y in tx or x in ty or not tx.isdisjoint(ty)

    def like(self, x: str, y: str) -> float:
        got = self.seen.get((x, y))
        if got is None:
            if len(self.seen) > 500_000:  # of this worker only
                self.seen.clear()
            got = self.seen[x, y] = token_likeness(x, y, self.led)
        return got

    def score(self, a: list[str], b: list[str]) -> float:
        return align(a, b, self.like)


def _scored(candidates: DataFrame, names: GivenNames) -> DataFrame:
    """candidates (form_id, person, a, b) plus score; a and b are tokens joined by blanks."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(names, False)  # sent with the function: built once, and bounded by ESTABLISHED
        for x in batches:
            scores = [aligner.score(a.split(), b.split()) for a, b in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(scores, pa.float64())], names=["form_id", "person", "score"])

    return candidates.select("form_id", "person", "a", "b").mapInArrow(score, "form_id long, person long, score double")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(TITLES))


def persons(forms: DataFrame, nicknames: dict[str, str] = NICKNAMES, least: int = 4) -> DataFrame:
    """(form_id, person): written forms with the number of the person each names.

    forms: (form_id long, f, m, s, n): plain given name, middle name ('' if none), surname and the rows that write it so; distinct.
    Forms without a given name or without a surname get no person.  least: letters a surname needs to have neighbours.
    """
    total = forms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def columned(c: str) -> Column:
        return F.transform(F.split(c, " "), lambda w: F.struct(w.alias("t"), F.lit(c == "f").alias("given")))

    words = forms.select("n", F.explode(F.concat(columned("f"), columned("s"))).alias("w"))
    counts = words.groupBy(F.col("w.t").alias("token")).agg(F.sum(F.when(F.col("w.given"), F.col("n")).otherwise(0)).alias("as_given"), F.sum(F.when(F.col("w.given"), 0).otherwise(F.col("n"))).alias("as_surname"))
    frequent, surnames, common = lexicon(counts.where(~F.col("token").isin(TITLES)), total)
    names = GivenNames(frequent, nicknames)
    parser = NameParser(names, surnames, common)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = list(map(parser.parse, *(x.column(i).to_pylist() for i in (2, 3, 4))))
            told = pa.array([p is not None for p in got])
            cols = list(zip(*(p for p in got if p is not None), strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([x.column(0).filter(told), x.column(1).filter(told), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["form_id", "n", "surname", "g", "loose", "mid", "a", "letters"])

    shown = forms.select("form_id", "n", "f", "m", "s").mapInArrow(parse, "form_id long, n long, surname string, g string, loose boolean, mid string, a string, letters string")
    # Combinations are joined by hash: c of surname and given name, d of these and the middle name.
    shown = stash(shown.withColumns({"c": F.xxhash64("surname", "g"), "d": F.when(~F.col("loose"), F.xxhash64("surname", "g", "mid"))}), "forms")
    near = stash(near_tokens(shown.groupBy(F.col("surname").alias("token")).agg(F.sum("n").alias("n")), least), "near")

    # Persons: the best attested (surname, given, middle) combinations.
    full = F.length("mid") > 1
    initial = F.col("mid") != ""
    of_key = Window.partitionBy("c")
    mids = shown.where("not loose").groupBy("c", "d", "surname", "g", "mid").agg(F.sum("n").alias("n"))
    by_initial = Window.partitionBy("c", F.substring("mid", 1, 1))
    mids = mids.withColumns({"k": F.count(F.when(full, 1)).over(by_initial), "full_mid": F.max(F.when(full, F.col("mid"))).over(by_initial)})
    mids = mids.withColumn("said", F.when(initial & ~full & (F.col("k") == 1), F.col("full_mid")).otherwise(F.col("mid")))
    mids = mids.withColumn("said_n", F.sum("n").over(Window.partitionBy("c", "said")))
    said = F.when(F.col("said") != "", F.struct("said_n", "said"))
    mids = mids.withColumns({"key_n": F.sum("n").over(of_key), "top": F.max(said).over(of_key), "all_n": F.sum(F.when(F.col("said") != "", F.col("n"))).over(of_key)})
    # A form without middle name goes to the person that most of the key's other rows name, if there is one; not where the surname is common.
    lent = (F.col("said") == "") & ~F.col("surname").isin(common) & (F.col("top.said_n") >= MOSTLY * F.col("all_n"))
    mids = stash(mids.select("c", "d", "surname", "g", F.when(lent, F.col("top.said")).otherwise(F.col("said")).alias("person_mid"), "n", "key_n"), "mids")
    # A key of which a better attested spelling is known makes no persons.
    over = mids.select(F.col("c").alias("near_c"), F.col("key_n").alias("near_n")).distinct()
    rivals = mids.select("c", "surname", "g", "key_n").distinct().join(near.withColumnRenamed("token", "surname"), "surname").select("c", F.xxhash64("near", "g").alias("near_c"), "key_n")
    beaten = rivals.join(over, "near_c").where("near_n >= key_n").select("c").distinct()
    led = mids.join(beaten, "c", "left_anti").select("d", "surname", "g", "person_mid", "n", F.xxhash64("surname", "g", "person_mid").alias("person"))
    led = stash(led, "persons")
    direct = shown.where("d is not null").select("form_id", "d").join(led.select("d", "person"), "d").select("form_id", "person")

    # Every other form is aligned with the persons of its surname's neighbourhood whose given name begins alike.
    people = led.groupBy("person").agg(F.sum("n").alias("rows"))
    reps = led.select("person", F.col("surname").alias("key"), F.substring("g", 1, 1).alias("i"), F.regexp_replace(F.concat_ws(" ", "g", "person_mid", "surname"), "  ", " ").alias("b")).distinct()
    loose = shown.join(direct.select("form_id"), "form_id", "left_anti")
    loose = stash(loose.select("form_id", F.col("surname").alias("key"), "a", F.explode_outer(F.split("letters", "")).alias("i"), F.xxhash64("surname", "g", "mid", F.lit("loose")).alias("alone")), "loose")
    own = loose.select("form_id", "key", "a", "i")
    wide = own.unionByName(own.join(near.withColumnRenamed("token", "key"), "key").select("form_id", F.col("near").alias("key"), "a", "i"))
    scores = _scored(wide.join(reps, ["key", "i"]), names).where(F.col("score") >= ALIGN_AT).groupBy("form_id", "person").agg(F.max("score").alias("score"))
    scores = scores.join(people, "person")
    w = Window.partitionBy("form_id")
    ranked = scores.withColumn("top", F.max("score").over(w)).where(F.col("score") > F.col("top") - MARGIN)
    ranked = ranked.withColumn("all_rows", F.sum("rows").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("rows"), F.desc("score"), "person")))
    attached = ranked.where((F.col("k") == 1) & (F.col("rows") >= MOSTLY * F.col("all_rows"))).select("form_id", "person")
    rest = loose.select("form_id", "alone").distinct().join(attached, "form_id", "left").select("form_id", F.coalesce("person", "alone").alias("person"))
    return direct.unionByName(rest)


def _has_letter(c: str) -> Column:
    """Whether the plain form is not empty, without forming it."""
    return F.col(c).rlike(r"[\p{L}\p{N}]")


def linked_people(people: DataFrame, nicknames: dict[str, str] = NICKNAMES, least: int = 4) -> DataFrame:
    """(id_1, id_2): rows of people that name the same person with different plain forms.

    Null or missing fname or sname: the row is left out; a null mname is ''.  Rows loaded twice count once; other columns are ignored; an
    empty table gives no rows.
    """
    rows = people.where(F.col("id").isNotNull() & ~is_missing("fname") & ~is_missing("sname") & _has_letter("fname") & _has_letter("sname"))
    rows = rows.select("id", plain("fname").alias("f"), F.coalesce(plain("mname"), F.lit("")).alias("m"), plain("sname").alias("s"))
    forms = stash(rows.groupBy("f", "m", "s").agg(F.count("*").alias("n")).withColumn("form_id", F.xxhash64("f", "m", "s")), "forms")
    tagged = rows.select("id", F.xxhash64("f", "m", "s").alias("form_id")).join(persons(forms, nicknames, least), "form_id").select("person", "form_id", "id").distinct()
    one, two = (tagged.select("person", F.col("form_id").alias(f"form_{k}"), F.col("id").alias(f"id_{k}")) for k in (1, 2))  # of one shape, so they share an exchange
    return one.join(two, "person").where("id_1 < id_2 and form_1 != form_2").select("id_1", "id_2")


def linked_couples(couples: DataFrame) -> DataFrame:
    """(id_1, id_2): rows of couples whose first-census person is the same, with different plain forms of namefrst_1.

    A household written down twice keeps the places (pernum) of its members, their relation, sex and race; ages differ by a
    year at most, birthplace and state agree, and the surname is within one edit.  Members of whom all that is known find the pairs of
    households; in such a pair of households an unknown age, birthplace or state agrees with any.  Two members are the same person if
    their given names align, or, where one is beyond recognition, if those of another two of the same households do.
    Rows without id, surname, place, relation, sex or race are linked to nothing; extra columns are ignored; an empty table gives no rows.
    """
    rows = couples.where(F.col("couple_id").isNotNull() & ~is_missing("namelast_1") & _has_letter("namelast_1")).select(
        F.col("couple_id").alias("id"), F.col("serial_1").alias("h"), F.col("pernum_1").alias("p"), F.xxhash64(census_text("relate_1"), census_text("sex_1"), census_text("race_1")).alias("kind"),
        census_code("bpl_1", "bpl").alias("bpl"), census_code("stateicp_1", "stateicp").alias("st"), F.expr("try_cast(trim(age_1) as double)").cast("int").alias("age"),
        F.when(~is_missing("namefrst_1"), plain("namefrst_1")).alias("name"), plain("namelast_1").alias("last"),
    )
    # Rows loaded twice only repeat pairs, which are made distinct below.
    rows = stash(rows.where("h is not null and p is not null"), "rows")
    surnames = rows.groupBy(F.col("last").alias("token")).agg(F.count("*").alias("n"))
    spelled = near_tokens(surnames).unionByName(surnames.select("token", F.col("token").alias("near")))
    known = rows.where("bpl is not null and st is not null and age is not null").select("h", "last", "age", F.xxhash64("p", "kind", "bpl", "st").alias("who"))
    left = known.join(spelled.withColumnRenamed("token", "last"), "last").select("h", F.col("near").alias("last"), "who", F.explode(F.sequence(F.col("age") - 1, F.col("age") + 1)).alias("age"))
    right = known.withColumnRenamed("h", "h_r")
    met = left.join(right, ["last", "who", "age"]).where("h != h_r").select(F.least("h", "h_r").alias("h1"), F.greatest("h", "h_r").alias("h2")).distinct()
    one, two = (rows.select(*[F.col(c).alias(f"{c}{k}") for c in ("h", "id", "bpl", "st", "age", "name", "last")], "p", "kind") for k in (1, 2))
    same = F.coalesce(F.abs(F.col("age1") - F.col("age2")) <= 1, F.lit(True)) & F.coalesce(F.col("bpl1") == F.col("bpl2"), F.lit(True)) & F.coalesce(F.col("st1") == F.col("st2"), F.lit(True))
    pairs = met.join(one, "h1").join(two, ["h2", "p", "kind"]).where(same & ((F.col("last1") == F.col("last2")) | close_tokens(folded(F.col("last1")), folded(F.col("last2")))))
    sure = F.col("age1").isNotNull() & F.col("age2").isNotNull() & F.col("bpl1").isNotNull() & F.col("bpl2").isNotNull() & F.col("st1").isNotNull() & F.col("st2").isNotNull()
    pairs = stash(pairs.select("id1", "id2", "h1", "h2", "name1", "name2", sure.alias("sure")).where("id1 != id2").distinct(), "pairs")
    words = rows.where("name is not null").select(F.explode(_words(F.col("name"))).alias("token")).groupBy("token").agg(F.count("*").alias("as_given"))
    frequent, _, _ = lexicon(words.withColumn("as_surname", F.lit(0).cast("long")), rows.count())
    names = GivenNames(frequent)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(names, True)
        split = lambda t: [w for w in t.split() if w not in TITLES]
        for x in batches:
            score = [-1.0 if a is None or b is None else aligner.score(split(a), split(b)) for a, b in zip(x.column(4).to_pylist(), x.column(5).to_pylist(), strict=True)]
            differ = [a is not None and b is not None and a != b for a, b in zip(x.column(4).to_pylist(), x.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in (0, 1, 2, 3, 6)), pa.array(differ), pa.array(score, pa.float64())], names=["id1", "id2", "h1", "h2", "sure", "differ", "score"])

    scored = pairs.mapInArrow(agree, "id1 long, id2 long, h1 long, h2 long, sure boolean, differ boolean, score double")
    fits = F.col("score") >= ALIGN_AT
    others = F.sum(fits.cast("int")).over(Window.partitionBy("h1", "h2")) - fits.cast("int")  # one pair of households, its members
    judged = scored.withColumn("others", others).where("differ").where((F.col("others") > 0) | (fits & F.col("sure")))
    return judged.select(F.least("id1", "id2").alias("id_1"), F.greatest("id1", "id2").alias("id_2"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = linked_people(read(spark, sf_dir, "people_dict").select("id", "fname", "mname", "sname"))
    couples = linked_couples(read(spark, sf_dir, "couples_csv"))
    tag = lambda d, name: d.select(F.lit(name).alias("table_name"), "id_1", "id_2")
    return tag(people, "people_dict").unionByName(tag(couples, "couples_csv"))


SQL: dict[str, str] = {}
QUERIES = {"p3_found": p3_found}
