"""String comparators on pairs of Python strings, each from 0 (nothing alike) to 1 (equal).

Common contract: if either string is empty the result is 0, if they are equal it is 1.  `divisor` says what a count
of common parts is divided by: the shorter, the longer or the mean of the two sizes.
"""

from __future__ import annotations

import bz2
import difflib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from functools import wraps
from itertools import permutations

import numpy as np

from mergekin.functions import coding
from mergekin.functions.phonetic import phonix_transform

DIVISORS: dict[str, Callable[[float, float], float]] = {"shortest": min, "longest": max, "average": lambda a, b: (a + b) / 2}


def _contract(score: Callable[..., float]) -> Callable[..., float]:
    @wraps(score)
    def checked(a: str, b: str, *args, **kwargs) -> float:
        if not a or not b:
            return 0.0
        return 1.0 if a == b else score(a, b, *args, **kwargs)

    return checked


def _bag_common(a: Iterable, b: Iterable) -> int:
    return (Counter(a) & Counter(b)).total()


@_contract
def exact(a: str, b: str) -> float:
    return 0.0


# --- Jaro family -------------------------------------------------------------------------------------------------


def _claimed(seq: list, other: list, window: int) -> list:
    """The items of seq that find an equal, still free item of other at most window places away, going left to right."""
    free, got = list(other), []
    for i, x in enumerate(seq):
        at = next((j for j in range(max(0, i - window), min(i + window + 1, len(free))) if free[j] == x), None)
        if at is not None:
            free[at] = None
            got.append(x)
    return got


@_contract
def jaro(a: str, b: str) -> float:
    """Jaro similarity. Each side claims matches in a pass of its own (unequal counts are averaged); half transpositions count."""
    window = max(len(a), len(b)) // 2 - 1
    x, y = _claimed(list(a), list(b), window), _claimed(list(b), list(a), window)
    if not x or not y:
        return 0.0
    common = (len(x) + len(y)) / 2
    crossed = sum(p != q for p, q in zip(x, y, strict=False)) / 2
    return (common / len(a) + common / len(b) + (common - crossed) / common) / 3


def common_prefix(a: str, b: str) -> int:
    return next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def winkler_boost(a: str, b: str, score: float) -> float:
    """score raised for a common beginning: at least one and at most three tenths of what is missing, whatever the prefix."""
    k = max(1, min(common_prefix(a, b) + 1, min(4, len(a), len(b)) - 1))
    return score + 0.1 * k * (1 - score)


@_contract
def winkler(a: str, b: str) -> float:
    score = jaro(a, b)
    return winkler_boost(a, b, score) if score > 0 else score


def sorted_words(s: str) -> str:
    return " ".join(sorted(s.split())) if " " in s else s


@_contract
def sort_winkler(a: str, b: str) -> float:
    """Winkler of the strings with their words in order; the comparator of all pipelines."""
    return winkler(sorted_words(a), sorted_words(b))


def _claimed_rows(a: np.ndarray, b: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_claimed() of many pairs: each row's claimed items, and how many. Rows are padded with -1 in a and -2 in b."""
    free, got, n = b.copy(), np.full(a.shape, -9, a.dtype), np.zeros(len(a), np.int64)
    at, widest = np.arange(b.shape[1]), int(window.max(initial=-1))
    for i in range(a.shape[1]):
        lo, hi = max(0, i - widest), min(i + widest + 1, b.shape[1])
        if lo >= hi:
            continue
        fits = (free[:, lo:hi] == a[:, i : i + 1]) & (np.abs(at[lo:hi] - i) <= window[:, None])
        j = fits.argmax(axis=1)
        rows = np.flatnonzero(fits[np.arange(len(a)), j])
        free[rows, lo + j[rows]] = -3
        got[rows, n[rows]] = a[rows, i]
        n[rows] += 1
    return got, n


def sort_winkler_many(a: list[str], b: list[str], rows: int = 4096) -> np.ndarray:
    """sort_winkler of many pairs at once, to the last bit the same."""
    out = np.zeros(len(a))
    x, y = [sorted_words(s) for s in a], [sorted_words(s) for s in b]
    equal = np.array([bool(p) and (p == q or s == t) and bool(s) and bool(t) for s, t, p, q in zip(a, b, x, y, strict=True)], bool)
    out[equal] = 1.0
    todo = np.array([i for i in range(len(a)) if not equal[i] and x[i] and y[i]], np.int64)
    long = np.array([max(len(x[i]), len(y[i])) for i in todo], np.int64)
    todo = todo[np.argsort(long, kind="stable")]
    for k in range(0, len(todo), rows):
        part = todo[k : k + rows]
        la, lb = (np.array([len(s[i]) for i in part], np.int64) for s in (x, y))
        one, two = (np.full((len(part), int(n.max())), pad, np.int32) for n, pad in ((la, -1), (lb, -2)))
        for m, n, s in ((one, la, x), (two, lb, y)):
            m[np.arange(m.shape[1]) < n[:, None]] = np.frombuffer("".join([s[i] for i in part]).encode("utf-32-le", "surrogatepass"), "<i4")
        window = np.maximum(la, lb) // 2 - 1
        (p, n), (q, m) = _claimed_rows(one, two, window), _claimed_rows(np.where(two == -2, -1, two), np.where(one == -1, -2, one), window)
        common, width = (n + m) / 2, min(p.shape[1], q.shape[1])
        crossed = ((p[:, :width] != q[:, :width]) & (np.arange(width) < np.minimum(n, m)[:, None])).sum(axis=1) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (common / la + common / lb + (common - crossed) / common) / 3
        prefix = np.cumprod(one[:, :3][:, : min(width, two.shape[1], one.shape[1])] == two[:, :3][:, : min(width, two.shape[1], one.shape[1])], axis=1).sum(axis=1)
        boost = np.maximum(1, np.minimum(prefix + 1, np.minimum(4, np.minimum(la, lb)) - 1))
        raised = score + 0.1 * boost * (1 - score)
        out[part] = np.where((n > 0) & (m > 0), np.where(score > 0, raised, score), 0.0)
    return out


@_contract
def perm_winkler(a: str, b: str) -> float:
    """The best Winkler score over all word orders of both strings. The orders of n words are n!, all of which are tried until one scores 1."""
    best = 0.0
    for p in permutations(a.split()):
        for q in permutations(b.split()):
            best = max(best, winkler(" ".join(p), " ".join(q)))
            if best >= 1.0:
                return best
    return best


@_contract
def two_level_jaro(a: str, b: str, same: Callable[[str, str], float] | None = None, threshold: float | None = None) -> float:
    """Jaro over words. With a comparator, words match from threshold on, the best first, and aligned words that are alike count as transposed."""
    if " " not in a and " " not in b:
        return 0.0 if same is None else same(a, b)
    if same is not None and threshold is None:
        raise ValueError("words compared by a function need a threshold")
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    window = max(len(x), len(y)) // 2

    def claim(seq: list[str], other: list[str]) -> list[str]:
        if same is None:
            return _claimed(seq, other, window)
        free, got = list(other), []
        for i, w in enumerate(seq):
            places = [(same(w, free[j]), -j) for j in range(max(0, i - window), min(i + window + 1, len(free))) if free[j] is not None]
            score, at = max((p for p in places if p[0] >= threshold), default=(0.0, 1))
            if at <= 0:
                free[-at] = None
                got.append(w)
        return got

    p, q = claim(x, y), claim(y, x)
    common = (len(p) + len(q)) / 2
    if not common:
        return 0.0
    crossed = sum((u != v) if same is None else (same(u, v) >= threshold) for u, v in zip(p, q, strict=False))
    return (common / len(x) + common / len(y) + (common - crossed) / common) / 3


# --- grams -------------------------------------------------------------------------------------------------------

_START, _END = "\x01", "\x02"


def grams(s: str, q: int, padded: bool) -> list[str]:
    t = _START * (q - 1) + s + _END * (q - 1) if padded else s
    return [t[i : i + q] for i in range(len(t) - q + 1)]


@_contract
def qgram(a: str, b: str, q: int = 2, divisor: str = "average", padded: bool = True, threshold: float | None = None) -> float:
    x, y = grams(a, q, padded), grams(b, q, padded)
    if not x or not y:
        return 0.0
    by = DIVISORS[divisor](len(x), len(y))
    if threshold is not None and min(len(x), len(y)) / by < threshold:
        return 0.0
    return _bag_common(x, y) / by


def bigram(a: str, b: str) -> float:
    return qgram(a, b, 2)


@_contract
def pos_qgram(a: str, b: str, q: int = 2, max_dist: int = 2, divisor: str = "average", padded: bool = True) -> float:
    """q-grams match only at places at most max_dist apart, the lowest place first."""
    x, y = grams(a, q, padded), grams(b, q, padded)
    if not x or not y:
        return 0.0
    by = DIVISORS[divisor](len(x), len(y))
    short, long_ = (x, y) if len(x) < len(y) else (y, x)
    return len(_claimed(short, long_, max_dist)) / by


@_contract
def sgram(a: str, b: str, classes: tuple[tuple[int, ...], ...] = ((0,), (0, 1), (1, 2)), divisor: str = "average", padded: bool = True) -> float:
    """Skip-grams: pairs of characters with so many between them, counted by class of skips."""
    s, t = ((_START + v + _END if padded else v) for v in (a, b))
    pairs = [tuple([v[i] + v[i + k + 1] for k in c for i in range(len(v) - k - 1)] for v in (s, t)) for c in classes]
    by = sum(DIVISORS[divisor](len(x), len(y)) for x, y in pairs)
    return sum(_bag_common(x, y) for x, y in pairs) / by if by else 0.0


# --- edits -------------------------------------------------------------------------------------------------------


def _edit_table(a: str, b: str, swaps: bool) -> list[list[int]]:
    d = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(d[i - 1][j] + 1, row[j - 1] + 1, d[i - 1][j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, d[i - 2][j - 2] + 1)
            row.append(best)
        d.append(row)
    return d


@_contract
def edit_dist(a: str, b: str) -> float:
    return 1 - _edit_table(a, b, False)[-1][-1] / max(len(a), len(b))


@_contract
def mod_edit_dist(a: str, b: str) -> float:
    """A swap of neighbours is one edit."""
    return 1 - _edit_table(a, b, True)[-1][-1] / max(len(a), len(b))


def edit_dist_edits(a: str, b: str) -> tuple[float, list[int]]:
    """(similarity, [insertions, deletions, substitutions]); a substitution is preferred where several edits are as short."""
    if not a or not b:
        return 0.0, [len(b), len(a), 0]
    d, i, j, edits = _edit_table(a, b, False), len(a), len(b), [0, 0, 0]
    score = 1 - d[i][j] / max(i, j)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            edits[2] += a[i - 1] != b[j - 1]
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            edits[1] += 1
            i -= 1
        else:
            edits[0] += 1
            j -= 1
    return score, edits


@_contract
def bag_dist(a: str, b: str) -> float:
    common = _bag_common(a, b)
    return 1 - (max(len(a), len(b)) - common) / max(len(a), len(b))


#: Groups of letters that count as nearly the same in local alignment, and its scores.
SW_GROUPS = ["aeiou", "dt", "gj", "lr", "mn", "bpv"]
SW_MATCH, SW_NEAR, SW_MISMATCH, SW_GAP, SW_EXTEND = 5, 2, -5, 5, 1
_SW_GROUP = {c: i for i, g in enumerate(SW_GROUPS) for c in g}


@_contract
def sw_dist(a: str, b: str, divisor: str = "average") -> float:
    """Smith-Waterman: score of the best local alignment, of the most that the divisor's length could reach."""
    n, m = len(a), len(b)
    d, best = [[0.0] * (m + 1) for _ in range(n + 1)], 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            step = SW_MATCH if x == y else SW_NEAR if _SW_GROUP.get(x, -1) == _SW_GROUP.get(y, -2) else SW_MISMATCH
            gap_a = max((d[i - k][j] - SW_GAP - k * SW_EXTEND for k in range(1, i)), default=0)
            gap_b = max((d[i][j - k] - SW_GAP - k * SW_EXTEND for k in range(1, j)), default=0)
            d[i][j] = max(0, d[i - 1][j - 1] + step, gap_a, gap_b)
            best = max(best, d[i][j])
    return best / (DIVISORS[divisor](n, m) * SW_MATCH)


#: Phonetic groups of letters (h, w and the blank are silent) and the costs within and between groups.
EDITEX_GROUPS = ["aeiouy", "bfpv", "cgjkqsxz", "dt", "l", "mn", "r", "hw "]
EDITEX_NEAR, EDITEX_FAR = 2, 3
_EDITEX_GROUP = {c: i for i, g in enumerate(EDITEX_GROUPS) for c in g}


@_contract
def editex(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a

    def cost(x: str, y: str) -> int:
        return 0 if x == y else EDITEX_NEAR if _EDITEX_GROUP.get(x, -1) == _EDITEX_GROUP.get(y, -2) else EDITEX_FAR

    def drops(s: str) -> list[int]:
        """Cost of dropping each letter, after the one before it."""
        silent = len(EDITEX_GROUPS) - 1
        after = (min(cost(p, q), EDITEX_NEAR) if _EDITEX_GROUP.get(q, -2) == silent else cost(p, q) for p, q in zip(s, s[1:], strict=False))
        return [EDITEX_FAR, *after]

    da, db = drops(a), drops(b)
    row = [0]
    for c in db:
        row.append(row[-1] + c)
    all_b, all_a = row[-1], sum(da)
    for x, cx in zip(a, da, strict=True):
        new = [row[0] + cx]
        for j, (y, cy) in enumerate(zip(b, db, strict=True), 1):
            new.append(min(row[j] + cx, new[j - 1] + cy, row[j - 1] + cost(x, y)))
        row = new
    return max(0.0, 1 - row[-1] / max(all_a, all_b))


#: Scores of syllable alignment (equal and different letters, letter against syllable start, equal and different starts, gaps).
SYL_SAME, SYL_OTHER, SYL_MIXED, SYL_START, SYL_STARTS_DIFFER, SYL_GAP, SYL_START_GAP = 1, -1, -4, 6, -2, -1, -3
_VOWELS = "aeiouy"


def syllable_starts(s: str) -> str:
    """s with the letters that start a syllable in upper case."""
    out = [s[0].upper(), *s[1:]]
    for i in range(1, len(s)):
        if out[i].lower() in _VOWELS:
            continue
        if i == len(s) - 1 or out[i + 1] in _VOWELS + "hrw":
            out[i] = out[i].upper()
        if out[i] in "HRW" and out[i - 1] <= "Z":
            out[i] = out[i].lower()
    return "".join(out)


@_contract
def syllable_align(a: str, b: str, do_phonix: bool = True, divisor: str = "average") -> float:
    if do_phonix:
        a, b = phonix_transform(a), phonix_transform(b)
        if not a or not b:
            return 0.0
    a, b = syllable_starts(a), syllable_starts(b)
    most = [sum(SYL_START if c.isupper() else SYL_SAME for c in s) for s in (a, b)]
    gap = lambda c: SYL_START_GAP if c.isupper() else SYL_GAP

    def pair(x: str, y: str) -> int:
        if x.isupper() and y.isupper():
            return SYL_START if x == y else SYL_STARTS_DIFFER
        if x.islower() and y.islower():
            return SYL_SAME if x == y else SYL_OTHER
        return SYL_MIXED

    row = [0]
    for y in b:
        row.append(row[-1] + gap(y))
    for x in a:
        new = [row[0] + gap(x)]
        for j, y in enumerate(b, 1):
            new.append(max(row[j] + gap(x), new[j - 1] + gap(y), row[j - 1] + pair(x, y)))
        row = new
    return max(0.0, row[-1] / DIVISORS[divisor](*most))


# --- common substrings, compression ------------------------------------------------------------------------------


def longest_common(a: str, b: str) -> tuple[int, str, str]:
    """(length of the longest common substring, a and b without it). Of several, the one that ends first in the longer string (b, if as long)."""
    short, long_, swapped = (b, a, True) if len(a) > len(b) else (a, b, False)
    best, at_s, at_l, row = 0, 0, 0, [0] * (len(short) + 1)
    for i, y in enumerate(long_, 1):
        new = [0]
        for j, x in enumerate(short, 1):
            new.append(row[j - 1] + 1 if x == y else 0)
            if new[j] > best:
                best, at_s, at_l = new[j], j, i
        row = new
    s, t = short[: at_s - best] + short[at_s:], long_[: at_l - best] + long_[at_l:]
    return (best, t, s) if swapped else (best, s, t)


def _all_common(a: str, b: str, least: int) -> tuple[int, str, str]:
    """Total length of repeatedly removed common substrings, and the rests. The first counts even if it is shorter than least."""
    total, a, b = longest_common(a, b)
    n = total
    while n >= least:
        n, x, y = longest_common(a, b)
        if n >= least:
            total, a, b = total + n, x, y
    return total, a, b


@_contract
def lcs(a: str, b: str, least: int = 2, divisor: str = "average") -> float:
    if least < 1:
        raise ValueError("least has to be at least 1")
    return sum(_all_common(x, y, least)[0] for x, y in ((a, b), (b, a))) / 2 / DIVISORS[divisor](len(a), len(b))


@_contract
def onto_lcs(a: str, b: str, least: int = 2, divisor: str = "average", p: float = 0.6) -> float:
    """Common substrings with the Winkler boost, less the Hamacher product of the rests, rescaled to 0 to 1."""
    share, differ = 0.0, 0.0
    for x, y in ((a, b), (b, a)):
        n, rx, ry = _all_common(x, y, least)
        share += n / DIVISORS[divisor](len(a), len(b)) / 2
        u, v = len(rx) / len(a), len(ry) / len(b)
        differ += u * v / (p + (1 - p) * (u + v - u * v)) / 2
    return (winkler_boost(a, b, share) - differ) / 2 + 0.5


@_contract
def seq_match(a: str, b: str) -> float:
    return sum(difflib.SequenceMatcher(None, x, y).ratio() for x, y in ((a, b), (b, a))) / 2


@_contract
def compression(a: str, b: str, coder: str = "zlib") -> float:
    """Normalised compression similarity; both joins are averaged, but for the arithmetic coder."""
    if coder == "arith":
        probs = coding.train(a + b)
        c1, c2, both = (coding.bits(x, probs) for x in (a, b, a + b))
    else:
        pack = {"zlib": zlib.compress, "bz2": bz2.compress}[coder]
        c1, c2, ab, ba = (len(pack(x.encode("utf-8"))) for x in (a, b, a + b, b + a))
        both = (ab + ba) / 2
    if max(c1, c2) == 0:
        return 0.0
    return max(0.0, 1 - (both - min(c1, c2)) / max(c1, c2))


@_contract
def char_histogram(a: str, b: str) -> float:
    """Cosine of the counts of blanks and letters a to z; digits and other characters do not count."""
    letters = " abcdefghijklmnopqrstuvwxyz"
    x, y = (Counter(c for c in s.lower() if c in letters) for s in (a, b))
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return min(1.0, sum(x[c] * y[c] for c in x) / norm) if norm else 0.0


#: Comparators by name. A name may carry the suffix '-winkler': the boost is then applied to scores strictly between 0 and 1.
COMPARATORS: dict[str, Callable[[str, str], float]] = {
    "exact": exact, "jaro": jaro, "winkler": winkler, "sortwinkler": sort_winkler, "permwinkler": perm_winkler, "bigram": bigram,
    **{f"{q}gram{d}": (lambda a, b, q=q, d=d: qgram(a, b, q, d, False)) for q in (1, 2, 3) for d in DIVISORS},
    **{f"{q}gramP{d}": (lambda a, b, q=q, d=d: qgram(a, b, q, d, True)) for q in (1, 2, 3) for d in DIVISORS},
    **{f"pos{q}gram{d}": (lambda a, b, q=q, d=d: pos_qgram(a, b, q, 2, d, False)) for q in (1, 2, 3) for d in DIVISORS},
    **{f"pos{q}gramP{d}": (lambda a, b, q=q, d=d: pos_qgram(a, b, q, 2, d, True)) for q in (1, 2, 3) for d in DIVISORS},
    **{f"sgram{d}": (lambda a, b, d=d: sgram(a, b, divisor=d, padded=False)) for d in DIVISORS},
    **{f"sgramP{d}": (lambda a, b, d=d: sgram(a, b, divisor=d)) for d in DIVISORS},
    "editdist": edit_dist, "mod_editdist": mod_edit_dist, "bagdist": bag_dist, "editex": editex, "seqmatch": seq_match,
    **{f"swdist{d}": (lambda a, b, d=d: sw_dist(a, b, d)) for d in DIVISORS},
    **{f"syllaligndist{d}": (lambda a, b, d=d: syllable_align(a, b, False, d)) for d in DIVISORS},
    **{f"lcs{k}{d}": (lambda a, b, k=k, d=d: lcs(a, b, k, d)) for k in (2, 3) for d in DIVISORS},
    **{f"ontolcs{k}{d}": (lambda a, b, k=k, d=d: onto_lcs(a, b, k, d)) for k in (2, 3) for d in DIVISORS},
    "compress-zlib": lambda a, b: compression(a, b, "zlib"), "compress-bz2": lambda a, b: compression(a, b, "bz2"), "compress-arith": lambda a, b: compression(a, b, "arith"),
    "twoleveljaro": two_level_jaro, "charhistogram": char_histogram,
}


def comparator(name: str) -> Callable[[str, str], float]:
    if not name.endswith("-winkler"):
        return COMPARATORS[name]
    base = COMPARATORS[name.removesuffix("-winkler")]

    def boosted(a: str, b: str) -> float:
        score = base(a, b)
        return winkler_boost(a, b, score) if 0 < score < 1 else score

    return boosted
