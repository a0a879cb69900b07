import random
from itertools import permutations

from mergekin.llm import p3_names as N

PEOPLE = "id long, fname string, mname string, sname string, n int, token string, person int"


def test_edit_distance_counts_swaps():
    assert N.edit_distance("marhta", "martha", 2) == 1
    assert N.edit_distance("jon", "john", 2) == 1
    assert N.edit_distance("abc", "xyz", 2) == 3
    assert N.spelling_distance("clizabcth", "elizabeth") == 2 and N.spelling_distance("burnst", "bumst") == 0


def test_near_tokens_against_brute_force(spark):
    rng = random.Random(3)
    words = list({"".join(rng.choice("bcdfg") for _ in range(rng.randint(4, 6))) for _ in range(400)})
    counts = {w: rng.randint(1, 5) for w in words}
    got = {(r.token, r.near) for r in N.near_tokens(spark.createDataFrame(list(counts.items()), "token string, n long")).collect()}
    ahead = lambda u, t: counts[u] > 1 and (counts[u] > counts[t] or (counts[u] == counts[t] and u < t))
    want = {(t, u) for t in words for u in words if t != u and ahead(u, t) and N.edit_distance(t, u, 1) <= 1}
    assert want <= got
    assert all(N.edit_distance(t, u, 2) <= 2 for t, u in got)


def like(**led):
    return lambda x, y: N.token_likeness(x, y, lambda p, q: led.get(p) == q)


def test_alignment():
    assert N.align(["mary", "krolt"], ["mary", "krolt"], like()) == 1.0
    assert N.align(["krolt", "mary"], ["mary", "krolt"], like()) == 1.0
    assert N.align(["m", "krolt"], ["mary", "ann", "krolt"], like()) > N.ALIGN_AT
    assert N.align(["molly", "krolt"], ["mary", "krolt"], like(molly="mary")) > 0.9
    assert N.align(["john", "krolt"], ["mary", "krolt"], like()) < N.ALIGN_AT
    assert N.align([], ["mary"], like()) == 0.0


def test_every_token_counts_however_many_there_are():
    many = ["anna", "berta", "clara", "dora", "emma", "frieda", "gerda", "hilda"]
    assert N.align([*many, "krolt"], ["krolt", *many[::-1]], like()) == 1.0
    assert N.align([*many[:5], "krolt"], [*many[:5], "vaurind"], like()) == (5 - 0.8) / 6
    assert N.align([*many, "krolt"], [*many, "vaurind"], like()) < N.align([*many, "krolt"], [*many, "krolt"], like())


def test_assignment_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        k, n = sorted((rng.randint(1, 6), rng.randint(1, 6)))
        m = [[rng.choice([-0.8, 0.6, 0.75, 0.92, 1.0]) for _ in range(n)] for _ in range(k)]
        assert abs(N.best_total(m) - max(sum(m[i][j] for i, j in enumerate(p)) for p in permutations(range(n), k))) < 1e-9


def test_lexicon_of_many_names_is_built_from_neighbourhoods():
    rng = random.Random(5)
    names = {"".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(4, 9))): rng.randint(3, 5000) for _ in range(3000)}
    g = N.GivenNames(names)
    for t in rng.sample(list(names), 60):
        longer = len(t) <= 5 and any(m >= 5 * names[t] and N.contracts(t, u) for u, m in names.items())
        slip = any(m >= 20 * names[t] and u != t and N.edit_distance(t, u, 1) <= 1 for u, m in names.items())
        assert (t in g.full) == (t not in N.NICKNAMES and not longer and not slip)


def test_given_names():
    g = N.GivenNames({"william": 900, "mary": 800, "margaret": 500, "john": 700, "wiliam": 9, "thomas": 300})
    assert g.targets("bill") == ["william"] and g.targets("wm") == ["william"] and g.targets("thos") == ["thomas"]
    assert g.targets("wiliam") == ["william"] and g.targets("margart") == ["margaret"] and g.targets("mar")[0] in ("mary", "margaret")
    assert g.targets("x") == [] and g.targets("zzzzzz") == []


def people(spark, rows):
    df = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], PEOPLE)
    return {(r.id_1, r.id_2) for r in N.linked_people(df).collect()}


def test_people(spark):
    base = [(100 + i, f, None, s) for i, (f, s) in enumerate([("william", "zerpin"), ("mary", "ostrand"), ("john", "vellick"), ("william", "gustov"), ("mary", "hallet")] * 4)]
    rows = [
        *base,
        (1, "Elizabeth", "Ann", "Drumlock"), (2, "ELIZABETH", None, "Drumlock"), (3, "Betty", "A.", "Drumlock"), (4, "elizabeth", "ann", "drumolck"), (5, "Drumlock", None, "Elizabeth"),
        (6, "elizabeth", "ann", "drumlock"), (7, None, None, "Drumlock"), (8, "Elizabeth", None, "n/e"), (9, "  ", "x", "Drumlock"), (10, "elizabeth", "ann", "drumlock"), (11, "elizabeth", "ann", "drumlock"),
        (6, "elizabeth", "ann", "drumlock"), (12, "John", None, "Drumlock"), (13, "william", None, "zerpinn"),
    ]
    base += [(0, "elizabeth", None, "other")]
    got = people(spark, rows)
    mine = {p for p in got if max(p) < 100}
    assert {(1, 2), (2, 6), (1, 4), (4, 6), (2, 4)} <= mine
    assert not any(p & {7, 8, 9, 12} for p in map(set, mine))
    assert (1, 6) not in mine and (6, 10) not in mine  # the same plain form
    assert (13, 100) in got or (13, 105) in got or any(13 in p for p in got)
    assert people(spark, []) == set()


def test_a_common_surname_tells_persons_apart_where_there_is_no_other(spark):
    rng = random.Random(2)
    syllables = ["bor", "dan", "fel", "gim", "hul", "jat", "kev", "lop", "mur", "nis"]
    other = ["".join(rng.sample(syllables, 3)) for _ in range(400)]
    filler = [(1000 + i, f, None, s) for i, (f, s) in enumerate([(f, s) for s in other for f in ("william", "mary", "john", "sarah")])]
    held = [(9000 + i, f, None, "arlen") for i, f in enumerate(["elizabeth", "margaret", "john"] * 60)]
    rows = [*filler, *held, (1, "elizabeth", "john", "arlen"), (2, "elizabeth", "j", "arlen"), (4, "mary", "trovinsk", "arlen"), (5, "mary", "trovinks", "arlen")]
    assert {p for p in people(spark, rows) if min(p) < 100} == {(1, 2), (4, 5)}


COUPLES = "couple_id long, relate_1 string, namefrst_1 string, namelast_1 string, serial_1 long, pernum_1 int, sex_1 string, race_1 string, bpl_1 string, age_1 string, stateicp_1 string, near string, p int"


def couples(spark, rows):
    return {(r.id_1, r.id_2) for r in N.linked_couples(spark.createDataFrame([(*r, "x", 1) for r in rows], COUPLES)).collect()}


def test_couples(spark):
    filler = [(100 + i, "1", n, f"Fam{i}", 900 + i, 1, "1.0", "1", "5", "50", "9") for i, n in enumerate(["William", "Mary", "John", "Jessica", "Isaac", "Constance"] * 4)]
    rows = [
        *filler,
        (1, "1.0", "ISAAC", "Woph", 1, 1, "1", "3.0", "6", "58.0", "1"), (2, "2.0", "Constance I", "Woph", 1, 2, "2", "3", "52", "59", "1"), (3, "3", None, "Woph", 1, 3, "2", "3", "9", "35", "1"),
        (4, "1", "Ike", "Woph", 2, 1, "1.0", "3", "6.0", "58", "1.0"), (5, "2", "Connie", "Woph", 2, 2, "2", "3", "999", "58", "1"), (6, "3", "Jessica", "Woph", 2, 3, "2", "3", "9", "36", "1"),
        (7, "1", "Isaac", "Woph", 3, 1, "1", "3", "6", "30", "1"), (1, "1.0", "ISAAC", "Woph", 1, 1, "1", "3.0", "6", "58.0", "1"), (8, None, None, None, None, None, None, None, None, None, None), (9, "1", "Ike", "Woph", 4, 1, "1", "3", "6", "old", "1"),
    ]
    assert couples(spark, rows) == {(1, 4), (2, 5)}
    assert couples(spark, []) == set()


def test_two_spellings_written_once_each_are_linked(spark):
    near = spark.createDataFrame([("drruyrt", 1), ("druryrt", 1)], "token string, n long")
    assert [tuple(r) for r in N.near_tokens(near).collect()] == [("druryrt", "drruyrt")]
    rows = [(i, "eleanor", None, f"unlike{c * 6}") for i, c in enumerate("bdgk")] + [(8, "eleanor", None, "drruyrt"), (9, "eleanor", None, "druryrt")]
    people = spark.createDataFrame(rows, "id long, fname string, mname string, sname string")
    assert [tuple(r) for r in N.linked_people(people).collect()] == [(8, 9)]
