"""The search on a small catalog of contrasting pairs."""

import pytest

from clausewright.functions import predicates as P
from clausewright.functions import vocab as V
from clausewright.plans import order, query, state
from clausewright.plans.query import Condition
from pyspark.sql import functions as F

SCHEMA = (
    "id long, alt_ids array<long>, name_zh string, name_ja string, name_en string, alias string, cat string, subs array<string>, attr string, race string, level int, link int,"
    "markers array<string>, scale int, atk int, def int, rarity string, region string, ban_o string, ban_t string, ban_m string, points int,"
    "clauses array<struct<pos:int,section:string,label:string,text:string,kind:string,opt:string,role:string>>"
)


def card(id, cat="m", subs=("effect",), clauses=(), **more):
    row = dict.fromkeys(["alt_ids", "name_zh", "name_ja", "name_en", "alias", "attr", "race", "level", "link", "markers", "scale", "atk", "def", "rarity", "region", "ban_o", "ban_t", "ban_m", "points"])
    row |= {"id": id, "cat": cat, "subs": list(subs), "clauses": [(i, "main", str(i), *c) for i, c in enumerate(clauses)]} | more
    return row


@pytest.fixture(scope="module")
def cards(spark):
    rows = [
        card(1, name_zh="青眼白龍", name_en="Blue-Eyes White Dragon", alt_ids=[101], attr="light", race="dragon", level=8, atk=3000, **{"def": 2500}, clauses=[("抽1張卡", "t", "m", None)]),
        card(2, name_zh="黑魔導", name_en="Dark_Magician", attr="dark", race="spellcaster", level=7, atk=2500, **{"def": 2100}, clauses=[("抽1張卡", "c", None, None), ("破壞", "t", "m", None)]),
        card(3, "m", ("link",), name_zh="連結", attr="dark", link=3, markers=["T", "BL"], atk=-2, clauses=[("怪獸2隻", "x", None, "mat"), ("抽卡", "q", "o", None)]),
        card(4, "s", ("equip",), name_zh="裝備", alias="別名", clauses=[("裝備", "se", "o", None)], ban_o="f", region="o"),
        card(5, "m", ("pendulum", "effect"), name_zh="靈擺", scale=0, level=4, atk=0, attr="fire", clauses=[("裝備", "se", "o", None)], points=0),
        card(6, "t", ("normal",), name_zh="100%", region="t"),
    ]
    return spark.createDataFrame([tuple(r[f.split()[0].strip()] for f in SCHEMA.replace("array<struct<pos:int,section:string,label:string,text:string,kind:string,opt:string,role:string>>", "x").split(",")) for r in rows], SCHEMA).cache()


def ids(cards, **given):
    return {r["id"]: r["rows"] for r in query.run(cards, Condition(**given)).collect()}


def test_axes(cards):
    assert set(ids(cards)) == {1, 2, 3, 4, 5, 6}
    assert set(ids(cards, cat={"m": 1}, attr={"dark": 1, "light": 1})) == {1, 2, 3}
    assert set(ids(cards, attr={"dark": -1})) == {1, 4, 5, 6}
    assert set(ids(cards, attr={"dark": 1}, race={"spellcaster": -1})) == {3}
    assert set(ids(cards, lm={"T": 1, "BL": -1})) == set()
    assert set(ids(cards, sub={"m:pendulum": 1})) == {5}
    assert set(ids(cards, sub={"m:effect": -1})) == {3, 4, 6}
    assert set(ids(cards, ban_o={"f": -1})) == {1, 2, 3, 5, 6}


def test_ranges_and_unknown(cards):
    assert set(ids(cards, atk=(0, None))) == {1, 2, 5}
    assert set(ids(cards, atk=(None, 0))) == {5}
    assert set(ids(cards, atkq=1)) == {3}
    assert set(ids(cards, atkq=-1)) == {1, 2, 4, 5, 6}
    assert set(ids(cards, sc=(0, 0))) == {5}
    assert set(ids(cards, lv=(7, 8))) == {1, 2}


def test_names_and_ids(cards):
    assert set(ids(cards, name="青%龍")) == {1}
    assert set(ids(cards, name="龍%青")) == set()
    assert set(ids(cards, name="別")) == {4}
    assert set(ids(cards, name="DARK_", name_language="en")) == {2}
    assert set(ids(cards, name="Blue_Eyes", name_language="en")) == set()
    assert set(ids(cards, name=" % ")) == {1, 2, 3, 4, 5, 6}
    assert set(ids(cards, code="101")) == {1}
    assert set(ids(cards, code="１")) == set() and set(ids(cards, code="x1")) == set()


def test_clauses_couple(cards):
    assert ids(cards, text="抽", kind={"t": 1}) == {1: [0]}
    assert ids(cards, text="怪獸") == {} and ids(cards, text="怪獸", text_materials=True) == {3: [0]}
    assert ids(cards, kind={"x": 1}) == {3: [0]}
    assert ids(cards, kind={"se": 1}) == {5: [0]}  # the equip card's own type is hidden
    assert ids(cards, opt={"tm": 1}) == {1: [0], 2: [1]}
    assert ids(cards, kind={"t": -1}) == {2: [0], 3: [0, 1], 4: [0], 5: [0]}
    assert ids(cards, text="%")[1] is None
    assert query.clause_marks(Condition(text=" 抽 ", kind={"t": 1})) == [("text", "抽"), ("kind", "t")]


def test_orders(cards):
    found = query.run(cards, Condition())
    assert [r["id"] for r in order.sort(found).collect()] == [1, 2, 5, 3, 4, 6]
    assert [r["id"] for r in order.sort(found, "atk", "desc").collect()][:3] == [1, 2, 5]
    assert [r["id"] for r in order.sort(found, "atk", "asc").collect()][:3] == [5, 2, 1]
    assert [r["id"] for r in order.sort(found, "lv", "desc").collect()][:3] == [1, 2, 5]
    assert [r["id"] for r in order.page(found, 9, 4, "id").collect()] == [5, 6]
    assert order.sort_of("x", "asc") == ("dom", "") and order.sort_of("atk", "?") == ("atk", "desc")
    assert order.page_numbers(9, 5, 1) == [1, None, 4, 5, 6, None, 9] and order.page_numbers(1, 1) == []


def test_frames_take_the_last_declared(spark):
    rows = spark.createDataFrame([("m", ["effect", "fusion"]), ("m", ["pendulum", "effect"]), ("m", []), ("s", ["normal"])], "cat string, subs array<string>")
    assert [r[0] for r in rows.select(order.frame_rank(F.col("cat"), F.col("subs"))).collect()] == [2, 1, 7, 0]


def test_ranges_of_matches(spark):
    df = spark.createDataFrame([("abcabc",), ("xbc",), (None,)], "t string")
    got = [r[0] for r in df.select(P.like_ranges(F.col("t"), ["ab", "c"])).collect()]
    assert [[tuple(x) for x in g] for g in got] == [[(0, 2), (2, 3)], [], []]


def test_decoding(spark):
    df = spark.createDataFrame([(0x1 | 0x20 | 0x1000000,), (0x2,), (0x4 | 0x100000,), (0x3,), (0x80000000 | 0x1,)], "t long")
    cat, subs = V.subtypes(F.col("t"))
    got = [(r[0], r[1]) for r in df.select(cat, subs).collect()]
    assert got == [("m", ["effect", "pendulum"]), ("s", ["normal"]), ("t", ["counter"]), (None, None), ("m", [])]
    assert [r[0] for r in df.select(V.unexplained_type_bits(F.col("t"))).collect()] == [0, 0, 0, 0, 0x80000000]
    one = spark.createDataFrame([(0x10,), (0,), (0x80,)], "a long").select(V.ATTR.code_of(F.col("a")), V.ATTR.is_unknown(F.col("a"))).collect()
    assert [tuple(r) for r in one] == [("light", False), (None, False), (None, True)]


def test_vocabulary_checks_itself():
    assert V.problems() == []
    broken = dict(V.DOMAINS)
    broken["attr"] = V.single("屬性", "bit", [("earth", "地", 3), ("water", "水", 2)])
    said = V.problems(broken)
    assert any("members" in x for x in said) and any("one bit" in x for x in said) and any("shares" in x for x in said)
    broken["optional"] = V.single("o", "text", [("m", "m")], carriers=("zz",), combos=(("m", "q", "o", ""),))
    assert sum("optional" in x for x in V.problems(broken)) >= 4
    assert len(V.digest()) == 64


def test_state_round_trip():
    q = Condition(name="青 眼&", cat={"m": 1}, attr={"dark": -1, "light": 1}, sub={"m:effect": 1}, atk=(1000, None), atkq=-1, opt={"qm": 1}, text_materials=True)
    text = state.stringify(state.State(q, "atk", "asc"))
    assert text == "name=%E9%9D%92%20%E7%9C%BC%26&textMat=1&cat=m&opt=qm&sub=m:effect&attr=light,-dark&atk=1000-&atkq=-1&sort=atk&dir=asc"
    back = state.parse("#" + text)
    assert state.stringify(back) == text and back.query.name == "青 眼&" and back.query.atk == (1000, None)
    assert state.canonical("cat=-t&zz=1&name=%ZZ&lv=a-b&atk=1e3-0x10&=1&kind=zz,t") == "kind=t&atk=1000-16"
    assert state.parse("sort=dom&dir=desc").direction == "" and state.parse(None) == state.State()


def test_counters():
    q = Condition(cat={"m": 1}, attr={"dark": 1, "fire": -1}, sub={"m:fusion": 1, "m:tuner": 1}, atk=(0, None), atkq=1, kind={"t": 1})
    assert state.count(q) == 6
    counts = state.axis_counts(q)
    assert counts["sub_m"] == 2 and counts["sub_m/0"] == 1 and counts["sub_m/1"] == 1 and counts["atk"] == 2
    assert state.tree_counts(q)["cat"] == 6 and state.tree_counts(Condition(cat={"m": 1}))["cat"] == 1
    assert state.optional_available({"c": 1}) == [False, False] and state.optional_available({"tn": 1}) == [True, False] and state.optional_available({}) == [True, True]
    assert set(state.expanded(q)) == {"cat", "sub_m", "attr", "atk", "kind", "optional", "sub_m/0", "sub_m/1"}
    assert [state.next_state(s) for s in (0, 1, -1)] == [1, -1, 0] and state.next_state(1, 2) == 0
    hidden = state.normalised(Condition(cat={"s": 1}, sub={"m:effect": 1, "s:equip": 1}, attr={"dark": 1}, atk=(1, 2), kind={"c": 1}, opt={"m": 1}))
    assert hidden.sub == {"s:equip": 1} and hidden.attr == {} and hidden.atk == (None, None) and hidden.opt == {}
