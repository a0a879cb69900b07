"""Rules: which attributes must, should and may agree, how alike they have to be, and how they are compared."""

from __future__ import annotations

from dataclasses import dataclass, field

ATOMIC_T, BOOTSTRAP_T, MERGE_T, WEIGHT_ATTR, BRIDGES_N = 0.9, 0.95, 0.85, 0.9, 10


@dataclass(frozen=True)
class Category:
    attributes: tuple[str, ...] = ()
    min_sim: float = ATOMIC_T
    least: int = 0


@dataclass(frozen=True)
class Rule:
    """A pair is kept if each category has at least `least` attributes whose values are at least min_sim alike."""

    name: str
    must: Category = field(default_factory=Category)
    core: Category = field(default_factory=Category)
    extra: Category = field(default_factory=Category)

    def category_of(self) -> dict[str, tuple[str, float]]:
        return {a: (name, c.min_sim) for name, c in (("must", self.must), ("core", self.core), ("extra", self.extra)) for a in c.attributes}


def rule(name: str, must: str = "", core: str = "", extra: str = "", n: tuple[int, int, int] = (0, 0, 0), t: float = ATOMIC_T, core_t: float | None = None, extra_t: float | None = None) -> Rule:
    return Rule(name, Category(tuple(must.split()), t, n[0]), Category(tuple(core.split()), t if core_t is None else core_t, n[1]), Category(tuple(extra.split()), t - 0.1 if extra_t is None else extra_t, n[2]))


_MORE = "occ marriage_year marriage_place1 marriage_place2 birth_year"


def rules(t: float = ATOMIC_T) -> dict[str, Rule]:
    """All rules under an atomic threshold t; extra attributes need 0.1 less unless set otherwise."""
    made = [
        rule("def1_core3_extra1", "", "fname sname addr1 parish", _MORE, (0, 3, 1), t),
        rule("def2_core3_extra0", "", "fname sname addr1 parish", _MORE, (0, 3, 0), t),
        rule("def3_must1_core2_extra1", "", "sname addr1 parish", _MORE, (0, 2, 1), t),
        rule("def4_must1_core2_extra0", "fname", "sname addr1 parish", _MORE, (1, 2, 0), t),
        rule("def5_must4", "fname sname addr1 parish", "", _MORE, (4, 0, 0), t),
        rule("def6_must3", "fname addr1 parish", "", f"sname {_MORE}", (3, 0, 0), t),
        rule("def7_must2", "fname sname", "", f"addr1 parish {_MORE}", (2, 0, 0), t),
        rule("def8_must3", "fname sname parish", "", f"addr1 {_MORE}", (3, 0, 0), t),
        rule("def9_must3", "fname sname addr1", "", f"parish {_MORE}", (3, 0, 0), t),
        rule("def10_must2_extra2", "fname sname", "", f"parish addr1 {_MORE}", (2, 0, 2), t),
        rule("def11_must2_extra2", "fname addr1", "", f"parish sname {_MORE}", (2, 0, 2), t),
        rule("def12_must2_extra2", "fname parish", "", f"sname addr1 {_MORE}", (2, 0, 2), t),
        rule("def13_must2_extra2", "sname addr1", "", f"fname parish {_MORE}", (2, 0, 2), t),
        rule("def14_core2_extra0", "fname sname", "addr1 parish", f"{_MORE} birth_place", (0, 0, 0), t),
        rule("def_ios", "fname sname", "addr1 marriage_year", "marriage_place2 parish birth_year birth_place", (0, 0, 0), t),
        rule("def_kil", "sname", "fname", "marriage_year marriage_place1 marriage_place2 birth_year birth_place", (0, 0, 0), t),
        rule("def15_bhic", "", "fname sname", "birth_year marriage_year marriage_place1 birth_place", (0, 2, 0), t, extra_t=t),
        rule("def_authors", "", "sname fname pub_name", "year", (0, 1, 0), t),
        rule("def_pubs", "pub_name", "year", "venue", (1, 0, 0), t, core_t=t - 0.1),
        rule("def_authors_scholar", "sname", "fname", "year", (0, 1, 0), t),
        rule("def_pubs_scholar", "pub_name", "", "year", (1, 0, 0), t),
        rule("def_hh", "fname race bpl", "sname birth_year", "state city occ", (2, 0, 0), t),
        rule("def_hh_link", "sname bpl fname race", "birth_year", "state occ", (2, 0, 0), t),
        rule("def_sg", "title", "artist year", "length album", (1, 0, 0), t),
    ]
    return {r.name: r for r in made}


#: Comparator of each attribute: 'JW' for text, 'MAD' for numbers (1 less a tenth for each unit apart).
NUMERIC = {"year", "birth_year", "marriage_year", "length"}


def comparator_of(attribute: str) -> str:
    return "MAD" if attribute in NUMERIC else "JW"
