"""Phonetic encoders of lower-case names. maxlen limits the code's length and pads with '0' where the scheme pads; negative is unlimited."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

_LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: Digits of the letters a to z in each scheme.
SOUNDEX_DIGITS = "01230120022455012623010202"
MOD_SOUNDEX_DIGITS = "01360240043788015936020505"
FUZZY_DIGITS = "01930170077455017693010709"
PHONIX_DIGITS = "01230720022455012683070808"

_SOUNDEX = str.maketrans(_LETTERS, SOUNDEX_DIGITS)
_MOD_SOUNDEX = str.maketrans(_LETTERS, MOD_SOUNDEX_DIGITS)
_FUZZY = str.maketrans(_LETTERS, FUZZY_DIGITS)
_PHONIX = str.maketrans(_LETTERS, PHONIX_DIGITS)


def _runs(s: str) -> str:
    return "".join(c for c, _ in groupby(s))


def _fit(code: str, maxlen: int) -> str:
    return code.ljust(maxlen, "0")[:maxlen] if maxlen > 0 else code


def _nothing(maxlen: int) -> str:
    return "0" * maxlen if maxlen > 0 else "0"


def soundex(s: str, maxlen: int = 4) -> str:
    """First letter, then the digits of the rest, equal neighbours once; vowels, h, w and y part them and fall away."""
    if not s:
        return _nothing(maxlen)
    rest = _runs(s[1:].replace(" ", "").translate(_SOUNDEX))
    return _fit(s[0] + rest.replace("0", ""), maxlen)


def mod_soundex(s: str, maxlen: int = 4) -> str:
    """Finer digits; vowels, h, w and y fall away before equal neighbours are joined."""
    if not s:
        return _nothing(maxlen)
    kept = re.sub(r"[aeiouhwy ]", "", s[1:])
    return _fit(s[0] + _runs(kept.translate(_MOD_SOUNDEX)), maxlen)


#: The letter that stands for a group of first letters.
PHONEX_FIRST = {"eiouy": "a", "p": "b", "v": "f", "kq": "c", "j": "g", "z": "s"}


#: What happens to a name before it is coded.
PHONEX_START = [(r"s+$", ""), (r"^(?:kn|wr)", lambda m: m.group()[1]), (r"^ph", "f"), (r"^h", "")]
#: Digit of every letter by what stands around it; m and n take the d and g after them along.
PHONEX_DIGITS = [(r"[mn][dg]*", "5"), (r"[dt](?=[^c])", "3"), (r"l(?![^aeiouy])", "4"), (r"r(?![^aeiouy])", "6"), (r"[bfpv]", "1"), (r"[cskgjqxz]", "2"), (r"[^1-6]", "0")]


def phonex(s: str, maxlen: int = 4) -> str:
    """Digits by context; the second letter falls away if it sounds like the first, further on a digit that follows itself does, vowels or not."""
    for pattern, to in PHONEX_START:
        s = re.sub(pattern, to, s)
    if not s:
        return _nothing(maxlen)
    first = next((to for group, to in PHONEX_FIRST.items() if s[0] in group), s[0])
    digits = first + s[1:]
    for pattern, digit in PHONEX_DIGITS:
        digits = re.sub(pattern, lambda m, digit=digit: digit * len(m.group()), digits)
    rest = digits[2:] if digits[1:2] == digits[0] else digits[1:]
    return _fit(first + _runs(rest.replace("0", "")), maxlen)


#: Gadd's replacements, in order: place, letters, replacement (- for none) and, where it matters, what has to stand before and after
#: (V a vowel, C a consonant, . anything).
PHONIX_RULES = """
ALL dg g
ALL co ko
ALL ca ka
ALL cu ku
ALL cy si
ALL ci si
ALL ce se
START cl kl . V
ALL ck k
END gc k
END jc k
START chr kr . V
START cr kr . V
START wr r
ALL nc nk
ALL ct kt
ALL ph f
ALL aa ar
ALL sch sh
ALL btl tl
ALL ght t
ALL augh arf
MIDDLE lj ld V V
ALL lough low
START q kw
START kn n
END gn n
ALL ghn n
END gne n
ALL ghne ne
END gnes ns
START gn n
MIDDLE gn n . C
END gn n
START ps s
START pt t
START cz c
MIDDLE wz z V .
MIDDLE cz ch
ALL lz lsh
ALL rz rsh
MIDDLE z s . V
ALL zz ts
MIDDLE z ts C .
ALL hroug rew
ALL ough of
MIDDLE q kw V V
MIDDLE j y V V
START yj y . V
START gh g
END gh e V .
START cy s
ALL nx nks
START pf f
END dt t
END tl til
END dl dil
ALL yth ith
START tj ch . V
START tsj ch . V
START ts t . V
ALL tch ch
MIDDLE wsk vskie V .
END wsk vskie V .
START mn n . V
START pn n . V
MIDDLE stl sl V .
END stl sl V .
END tnt ent
END eaux oh
ALL exci ecs
ALL x ecs
END ned nd
ALL jr dr
END ee ea
ALL zs s
MIDDLE r ah V C
END r ah V .
MIDDLE hr ah V C
END hr ah V .
END hr ah V .
END re ar
END r ah V .
ALL lle le
END le ile C .
END les iles C .
END e -
END es s
END ss as V .
END mb m V .
ALL mpts mps
ALL mps ms
ALL mpt mt
"""


def _phonix_pattern(place: str, letters: str, before: str, after: str) -> re.Pattern:
    """A replacement's place and neighbours as a regular expression."""
    look_back = {".": "", "V": "(?<=[aeiouy])", "C": "(?<=[^aeiouy])"}[before]
    look_on = {".": "", "V": "(?=[aeiouy])", "C": "(?=[^aeiouy])"}[after]
    body = look_back + re.escape(letters) + look_on
    return re.compile({"ALL": body, "START": r"\A" + body, "END": body + r"\Z", "MIDDLE": r"(?<!\A)" + body + r"(?!\Z)"}[place])


_PHONIX_STEPS = [
    (_phonix_pattern(place, letters, *(context or [".", "."])), "" if to == "-" else to)
    for place, letters, to, *context in (line.split(" ") for line in PHONIX_RULES.strip().splitlines())
]


def phonix_transform(s: str) -> str:
    """s after Gadd's replacements. A replacement that makes its own pattern anew is applied again from there."""
    for pattern, to in _PHONIX_STEPS:
        at = 0
        while found := pattern.search(s, at):
            s = s[: found.start()] + to + s[found.end() :]
            at = found.start()
            if pattern.pattern.startswith(r"\A") or (to and pattern.search(to)):
                break
    return s


def phonix(s: str, maxlen: int = 4) -> str:
    if not s:
        return "a" + "0" * max(0, maxlen - 1)
    t = phonix_transform(s)
    if not t:
        return "a" + "0" * max(0, maxlen - 1)
    first = "V" if t[0] in "aeiouy" else t[0]
    return _fit(first + _runs(t[1:].replace(" ", "").translate(_PHONIX)).replace("0", ""), maxlen)


#: Replacements in the order they are made, before and after vowels become a; (?<=.) is any place but the first, and a single letter is also its own end.
NYSIIS_ENDS = [(r"[sz]+$", ""), (r"^mac", "mc"), (r"^pf", "f"), (r"n[td]$", "n"), (r"(?:dt|rt|rd)$", "d"), (r"[yei]e$", "y"), (r"(?<=[ie])x$", "c")]
NYSIIS_STEPS = [
    (r"[eiou]", "a"), (r" ", ""), (r"aw", "a"), (r"ght", "gt"), (r"dg", "g"), (r"ph", "f"), (r"(?<=.)ah", "a"), (r"(?<=.)ha", "a"), (r"kn", "n"), (r"k", "c"), (r"(?<=.)m", "n"), (r"(?<=.)q", "g"),
    (r"sh", "s"), (r"sch", "s"), (r"yw", "y"), (r"wr", "r"), (r"^(.)$", r"\1\1"), (r"(?<=.)y(?=.)", "a"), (r"(?<=.)z", "s"), (r"ay$", "y"), (r"a+$", ""), (r"(.)\1+", r"\1"),
]


def nysiis(s: str, maxlen: int = 4) -> str:
    """All replacements in order; a vowel at the beginning stays what it was.

    One habit is kept as the users of the scheme know it: where ev stands after the first two letters, the name without its last two
    letters is followed by the name without its first two, in which ev is ef.
    """
    for pattern, to in NYSIIS_ENDS:
        s = re.sub(pattern, to, s)
    if s.find("ev", 2) >= 0:
        s = s[:-2] + s[2:].replace("ev", "ef")
    code = s
    for pattern, to in NYSIIS_STEPS:
        code = re.sub(pattern, to, code)
    if s[:1] in ("a", "e", "i", "o", "u"):
        code = s[0] + code[1:]
    return code[:maxlen] if maxlen > 0 else code


#: Replacements of fuzzy soundex at the beginning, at the end, and anywhere.
FUZZY_START = {"cs": "ss", "cz": "ss", "ts": "ss", "tz": "ss", "gn": "nn", "hr": "rr", "wr": "rr", "hw": "ww", "kn": "nn", "ng": "nn"}
FUZZY_END = {"ch": "kk", "nt": "tt", "rt": "rr", "rdt": "rr"}
FUZZY_ANY = {
    "chl": "kl", "chr": "kr", "mac": "mk", "nst": "nss", "sch": "sss", "tio": "sio", "tia": "sio", "tch": "chh", "ca": "ka", "cc": "kk",
    "ck": "kk", "ce": "se", "cl": "kl", "cr": "kr", "ci": "si", "co": "ko", "cu": "ku", "cy": "sy", "dg": "gg", "gh": "hh", "mc": "mk", "pf": "ff", "ph": "ff",
}


def fuzzy_soundex(s: str, maxlen: int = 4) -> str:
    """Letter groups are replaced before the digits. Known for two habits that are kept: a two-letter ending is looked up at the end but
    taken off the front, and the inner pairs are looked up at the head of the name."""
    if not s:
        return _nothing(maxlen)
    head, tail = {**FUZZY_START, **FUZZY_ANY}, {**FUZZY_END, **FUZZY_ANY}
    parts, rest, end = [], s, ""
    for n in (3, 2):
        if rest[:n] in head and len(rest) >= n:
            parts, rest = [head[rest[:n]]], rest[n:]
            break
    if rest[-3:] in tail:
        end, rest = tail[rest[-3:]], rest[:-3]
    elif rest[-2:] in tail:
        end, rest = tail[rest[-2:]], rest[2:]
    pair = FUZZY_ANY.get(s[:2])
    while rest:
        if rest[:3] in FUZZY_ANY and len(rest) >= 3:
            parts.append(FUZZY_ANY[rest[:3]])
            rest = rest[3:]
        elif pair is not None and len(rest) >= 2:
            parts.append(pair)
            rest = rest[2:]
        else:
            parts.append(rest[0])
            rest = rest[1:]
    t = "".join(parts) + end
    code = t[0]
    for c in t[1:].replace(" ", "").translate(_FUZZY):
        if c != code[-1]:
            code += c
    return _fit(code.replace("0", ""), maxlen)


def freq_vector(s: str, scheme: str | None = None) -> list[int] | None:
    """Counts per letter, or per digit of a scheme (phonix, soundex, mod_soundex); other characters are skipped. None for the empty name."""
    if not s:
        return None
    table = {None: None, "phonix": PHONIX_DIGITS, "soundex": SOUNDEX_DIGITS, "mod_soundex": MOD_SOUNDEX_DIGITS}[scheme]
    size = 26 if table is None else int(max(table)) + 1
    out = [0] * size
    for c in s.lower():
        at = _LETTERS.find(c)
        if at >= 0:
            out[at if table is None else int(table[at])] += 1
    return out


# --- double metaphone ----------------------------------------------------------------------------------------------


class _Word:
    """A name with look-around, and the code written so far."""

    def __init__(self, s: str):
        self.s, self.n, self.i, self.code = s, len(s), 0, []
        self.slavic = any(x in s for x in ("w", "k", "cz", "witz"))
        self.germanic = s.startswith(("van ", "von ", "sch"))

    def at(self, offset: int, *options: str) -> bool:
        """Whether one of the options stands at so many letters from here (and not before the beginning)."""
        start = self.i + offset
        return start >= 0 and any(self.s.startswith(o, start) and o for o in options)

    def char(self, offset: int) -> str:
        k = self.i + offset
        return self.s[k] if 0 <= k < self.n else ""

    def vowel(self, offset: int) -> bool:
        c = self.char(offset)
        return c != "" and c in _DM_VOWELS

    def put(self, code: str, step: int) -> None:
        self.code.append(code)
        self.i += step

    def double(self, code: str) -> None:
        """One code for the letter, which may be written twice."""
        self.put(code, 2 if self.char(1) == self.char(0) else 1)


_DM_VOWELS = "aeiouy"


def _b(w: _Word) -> None:
    w.double("p")


def _c(w: _Word) -> None:
    if w.i > 1 and not w.vowel(-2) and w.at(-1, "ach") and w.char(2) != "i" and (w.char(2) != "e" or w.at(-2, "bacher", "macher")):
        w.put("k", 2)
    elif w.i == 0 and w.at(0, "caesar"):
        w.put("s", 2)
    elif w.at(0, "chia"):
        w.put("k", 2)
    elif w.at(0, "ch"):
        if w.i > 0 and w.at(0, "chae"):
            w.put("k", 2)
        elif w.i == 0 and w.at(1, "harac", "haris", "hor", "hym", "hia", "hem") and not w.s.startswith("chore"):
            w.put("k", 2)
        elif w.germanic or w.at(-2, "orches", "archit", "orchid") or w.at(2, "t", "s"):
            w.put("k", 2)
        elif (w.at(-1, "a", "o", "u", "e") or w.i == 0) and (w.at(2, "l", "r", "n", "m", "b", "h", "f", "v", "w", " ") or w.i + 2 >= w.n):
            w.put("k", 2)
        elif w.i > 0:
            w.put("k" if w.s.startswith("mc") else "x", 2)
        else:
            w.put("x", 2)
    elif w.at(0, "cz") and not w.at(-2, "wicz"):
        w.put("s", 2)
    elif w.at(1, "cia"):
        w.put("x", 3)
    elif w.at(0, "cc") and not (w.i == 1 and w.s[0] == "m"):
        if w.at(2, "i", "e", "h") and not w.at(2, "hu"):
            w.put("ks" if (w.i == 1 and w.s[0] == "a") or w.at(-1, "uccee", "ucces") else "x", 3)
        else:
            w.put("k", 2)
    elif w.at(0, "ck", "cg", "cq"):
        w.put("k", 2)
    elif w.at(0, "ci", "ce", "cy"):
        w.put("s", 2)
    elif w.at(1, " c", " q", " g"):
        w.put("k", 3)
    else:
        w.put("k", 2 if w.at(1, "c", "k", "q") and not w.at(1, "ce", "ci") else 1)


def _d(w: _Word) -> None:
    if w.at(0, "dg"):
        w.put("j", 3) if w.at(2, "i", "e", "y") else w.put("tk", 2)
    else:
        w.put("t", 2 if w.at(0, "dt", "dd") else 1)


def _g(w: _Word) -> None:
    if w.char(1) == "h":
        if w.i > 0 and not w.vowel(-1):
            w.put("k", 2)
        elif w.i == 0:
            w.put("j" if w.char(2) == "i" else "k", 2)
        elif (w.i > 1 and w.at(-2, "b", "h", "d")) or (w.i > 2 and w.at(-3, "b", "h", "d")) or (w.i > 3 and w.at(-4, "b", "h")):
            w.put("", 2)
        elif w.i > 2 and w.char(-1) == "u" and w.at(-3, "c", "g", "l", "r", "t"):
            w.put("f", 2)
        else:
            w.put("k" if w.i > 0 and w.char(-1) != "i" else "", 2)
    elif w.char(1) == "n":
        if w.i == 1 and w.s[0] in _DM_VOWELS and not w.slavic:
            w.put("kn", 2)
        else:
            w.put("n" if not w.at(2, "ey") and w.char(1) != "y" and not w.slavic else "kn", 2)
    elif w.at(1, "li") and not w.slavic:
        w.put("kl", 2)
    elif w.i == 0 and (w.char(1) == "y" or w.at(1, "es", "ep", "eb", "el", "ey", "ib", "il", "in", "ie", "ei", "er")):
        w.put("k", 2)
    elif w.at(1, "er", "y") and not w.s.startswith(("danger", "ranger", "manger")) and not w.at(-1, "e", "i") and not w.at(-1, "rgy", "ogy"):
        w.put("k", 2)
    elif w.at(1, "e", "i", "y") or w.at(-1, "aggi", "oggi"):
        w.put("k" if w.germanic or w.at(1, "et") else "j", 2)
    else:
        w.double("k")


def _h(w: _Word) -> None:
    if (w.i == 0 or w.vowel(-1)) and w.vowel(1):
        w.put("h", 2)
    else:
        w.i += 1


def _j(w: _Word) -> None:
    spanish = w.s.startswith("san ")
    if w.at(0, "jose") or spanish:
        w.put("h" if (w.i == 0 and w.char(4) in ("", " ")) or spanish else "j", 1)
        return
    if w.i == 0:
        code = "j"
    elif w.vowel(-1) and not w.slavic and w.char(1) in ("a", "o"):
        code = "j"
    elif w.i == w.n - 1:
        code = "j"
    else:
        code = "" if w.at(1, "l", "t", "k", "s", "n", "m", "b", "z") or w.at(-1, "s", "k", "l") else "j"
    w.put(code, 2 if w.char(1) == "j" else 1)


def _l(w: _Word) -> None:
    w.double("l")


def _m(w: _Word) -> None:
    silent_b = w.at(-1, "umb") and (w.i + 2 >= w.n or w.at(2, "er"))
    w.put("m", 2 if silent_b or w.char(1) == "m" else 1)


def _p(w: _Word) -> None:
    w.put("f", 2) if w.char(1) == "h" else w.put("p", 2 if w.at(1, "p", "b") else 1)


def _r(w: _Word) -> None:
    french = w.i == w.n - 1 and not w.slavic and w.at(-2, "ie") and not w.at(-4, "me", "ma")
    w.put("" if french else "r", 2 if w.char(1) == "r" else 1)


def _s(w: _Word) -> None:
    if w.at(-1, "isl", "ysl"):
        w.i += 1
    elif w.i == 0 and w.at(0, "sugar"):
        w.put("x", 1)
    elif w.at(0, "sh"):
        w.put("s" if w.at(1, "heim", "hoek", "holm", "holz") else "x", 2)
    elif w.at(0, "sio", "sia"):
        w.put("s", 3)
    elif (w.i == 0 and w.at(1, "m", "n", "l", "w")) or w.at(1, "z"):
        w.put("s", 2 if w.at(1, "z") else 1)
    elif w.at(0, "sc"):
        if w.char(2) == "h":
            if w.at(3, "oo", "er", "en", "uy", "ed", "em"):
                w.put("x" if w.at(3, "er", "en") else "sk", 3)
            else:
                w.put("x", 3)
        else:
            w.put("s" if w.at(2, "i", "e", "y") else "sk", 3)
    else:
        french = w.i == w.n - 1 and w.at(-2, "ai", "oi")
        w.put("" if french else "s", 2 if w.at(1, "s", "z") else 1)


def _t(w: _Word) -> None:
    if w.at(0, "tion", "tia", "tch"):
        w.put("x", 3)
    elif w.at(0, "th", "tth"):
        w.put("t" if w.at(2, "om", "am") or w.germanic else "0", 2)
    else:
        w.put("t", 2 if w.at(1, "t", "d") else 1)


def _w(w: _Word) -> None:
    if w.at(0, "wr"):
        w.put("r", 2)
    elif w.i == 0 and (w.vowel(1) or w.at(0, "wh")):
        w.put("a", 1)
    elif (w.i == w.n - 1 and w.vowel(-1)) or w.at(-1, "ewski", "ewsky", "owski", "owsky") or w.s.startswith("sch"):
        w.i += 1
    elif w.at(0, "wicz", "witz"):
        w.put("ts", 4)
    else:
        w.i += 1


def _x(w: _Word) -> None:
    silent = w.i == w.n - 1 and (w.at(-3, "iau", "eau") or w.at(-2, "au", "ou"))
    w.put("" if silent else "ks", 2 if w.at(1, "c", "x") else 1)


def _z(w: _Word) -> None:
    w.put("j", 2) if w.char(1) == "h" else w.put("s", 2 if w.char(1) == "z" else 1)


_DM: dict[str, Callable[[_Word], None]] = {
    "b": _b, "c": _c, "d": _d, "f": lambda w: w.double("f"), "g": _g, "h": _h, "j": _j, "k": lambda w: w.double("k"), "l": _l, "m": _m,
    "n": lambda w: w.double("n"), "p": _p, "q": lambda w: w.double("k"), "r": _r, "s": _s, "t": _t, "v": lambda w: w.double("f"), "w": _w, "x": _x, "z": _z,
}


def dmetaphone(s: str, maxlen: int = 4) -> str:
    """The primary Double Metaphone code in lower case: 'th' gives '0', a vowel counts only at the beginning, as 'a'. The engine's blocking key."""
    if not s:
        return ""
    w = _Word(s)
    if s.startswith(("gn", "kn", "pn", "wr", "ps")):
        w.i = 1
    if s[0] == "x":
        w.put("s", 1)
    while w.i < w.n and (maxlen <= 0 or sum(map(len, w.code)) < maxlen):
        c = w.char(0)
        if c in _DM_VOWELS:
            if w.i == 0:
                w.code.append("a")
            w.i += 1
        elif c in _DM:
            _DM[c](w)
        else:
            w.i += 1
    code = "".join(w.code)
    return code[:maxlen] if maxlen > 0 else code


ENCODERS: dict[str, Callable[[str, int], str]] = {
    "soundex": soundex, "mod_soundex": mod_soundex, "phonex": phonex, "phonix": phonix, "nysiis": nysiis, "dmetaphone": dmetaphone, "fuzzy_soundex": fuzzy_soundex,
}


def encoder(name: str) -> Callable[[str], str]:
    """By name; a trailing 4 limits the code to four characters, without it there is no limit. 'phonix_transform' only replaces."""
    if name == "phonix_transform":
        return phonix_transform
    limited = name.endswith("4")
    encode = ENCODERS[name.removesuffix("4")]
    return lambda s: encode(s, 4 if limited else -1)
