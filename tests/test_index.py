"""The search index, judgments and displays."""

from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import entities, merge
from clausewright.plans import query
from clausewright.plans.query import Condition


def test_index_rows_are_searchable(spark):
    raw = spark.createDataFrame(
        [(1, 0x1 | 0x20, 2000, -2, 4, 0x2000, 0x20, 0, 3), (2, 0x1 | 0x20 | 0x4000000, 1500, 0x42, 2, 1, 0x10, 0, 1), (3, 0x2 | 0x40000, 0, 0, 0, 0, 0, 0, 2)],
        "id long, type long, atk int, def int, level long, race long, attribute long, setcode long, ot int",
    ).withColumns({"alias": F.lit(0).cast("long"), "name": F.lit("n"), "desc": F.lit("")})
    extra = spark.createDataFrame([(1, [9], "龍", None, None, "text\n※別名", "UR", 0, "f", None, None), (2, [], "連", None, None, "x", "X", 5, None, None, None), (3, [], "裝", None, None, "y", None, None, None, None, None)], "id long, alt_ids array<long>, name_zh string, name_ja string, name_en string, body string, rarity string, points int, ban_o string, ban_t string, ban_m string")
    clauses = spark.createDataFrame([(1, 1, "main", "②", "b", "t", "m", None), (1, 0, "main", "①", "a", "x", None, "mat")], "id long, pos int, section string, label string, text string, kind string, opt string, role string")
    index = entities.index_rows(entities.decoded(raw).join(extra, "id"), clauses).cache()
    got = {r["id"]: r for r in index.collect()}
    assert (got[1]["cat"], got[1]["subs"], got[1]["attr"], got[1]["race"], got[1]["level"], got[1]["link"], got[1]["points"], got[1]["alias"], got[1]["rarity"]) == ("m", ["effect"], "dark", "dragon", 4, None, None, "別名", "UR")
    assert (got[2]["link"], got[2]["level"], got[2]["markers"], got[2]["def"], got[2]["rarity"], got[2]["points"]) == (2, None, ["TL", "B"], None, None, 5)
    assert (got[3]["cat"], got[3]["subs"], got[3]["atk"], got[3]["region"], got[3]["clauses"]) == ("s", ["equip"], None, "t", [])
    assert [c["label"] for c in got[1]["clauses"]] == ["①", "②"]
    assert {r["id"]: r["rows"] for r in query.run(index, Condition(opt={"tm": 1}, dfq=1)).collect()} == {1: [1]}


JUDGED = [
    # kind, source of the row; kind, optional, role judged; kind, source, role, review, optional taken, outcome
    (("t", "official"), ("c", "m", None), ("c", "llm", None, True, "m", "late_official_conflict")),
    (("t", "official"), ("t", "o", None), ("t", "official", None, False, "o", "judgment_confirmed")),
    (("t", "official"), (None, "o", None), ("t", "official", None, False, "o", "judgment_confirmed")),
    (("x", "rule"), ("t", "o", None), ("x", "rule", None, False, None, "judgment_vs_rule")),
    (("x", "rule"), (None, "o", None), ("x", "rule", None, False, None, "judgment_vs_rule")),
    (("x", "rule"), ("x", None, "mat"), ("x", "rule", None, False, None, None)),
    ((None, None), ("x", None, "mat"), ("x", "llm", "mat", False, None, "judged")),
    ((None, None), ("q", "o", None), ("q", "llm", None, False, "o", "judged")),
    ((None, None), ("", "o", None), (None, None, None, False, None, "judgment_blank")),
    ((None, None), (None, "o", None), (None, None, None, False, None, "judgment_blank")),
    ((None, None), None, (None, None, None, False, None, None)),
]


def test_judgments_by_what_gave_the_kind(spark):
    clauses = spark.createDataFrame([(i, "m", "1", kind, None, source, None) for i, ((kind, source), *_) in enumerate(JUDGED)], "id int, section string, label string, kind string, role string, source string, needs_review boolean")
    given = [(i, "m", "1", *said, 2) for i, (_, said, _) in enumerate(JUDGED) if said] + [(7, "m", "1", "x", None, None, 1)]  # an earlier one
    judged = spark.createDataFrame(given, "id int, section string, label string, kind string, optional string, role string, seq int")
    got = {r["id"]: (r["kind"], r["source"], r["role"], r["needs_review"], r["judged_optional"], r["judgment"]) for r in merge.judged(clauses, judged).collect()}
    assert got == {i: wanted for i, (*_, wanted) in enumerate(JUDGED)}


MAY, MUST, NONE = "①：発動できる。", "①：この効果は発動する。", "①：強くなる。"
OPTIONALS = [
    # kind, text, unsplit, mandatory, judged; optional, by, pending, dropped, validation
    ("t", MAY, False, False, None, ("o", "rule", None, [], None)),
    ("q", MUST, False, False, None, ("m", "rule", None, [], None)),
    ("q", MUST, False, False, "o", ("o", "llm", None, [], None)),
    ("t", NONE, False, False, None, (None, None, "no_activation", [], None)),
    ("t", "", False, False, None, (None, None, "no_text", [], None)),
    ("t", None, False, True, None, ("m", "official", None, [], "no_text")),
    ("t", MAY, True, False, None, (None, None, "unsplit", [], None)),
    ("t", MAY, True, True, None, ("m", "official", None, [], "unsplit")),
    ("t", MUST, False, True, "o", ("m", "official", None, [], "agree")),
    ("t", MAY, False, True, None, ("m", "official", None, [], "disagree")),
    ("sn", MAY, False, False, None, (None, None, None, [], None)),
    ("sn", MAY, False, False, "m", ("m", "llm", None, [], None)),
    ("sn", NONE, False, True, None, ("m", "official", None, [], "no_activation")),
    ("c", MAY, False, False, "o", (None, None, None, ["judgment_optional_dropped"], None)),
    ("c", MUST, False, True, "o", (None, None, None, ["mandatory_other_kind", "judgment_optional_dropped"], "agree")),
    (None, MUST, False, True, None, (None, None, None, ["mandatory_kind_unknown"], "agree")),
    (None, MAY, False, False, None, (None, None, None, [], None)),
]


def test_optional_values_by_their_ladder(spark):
    rows = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(OPTIONALS)], "id int, kind string, text_ja string, unsplit boolean, mandatory boolean, judged_optional string")
    out = merge.optionals(rows)
    assert {r["id"]: (r["optional"], r["optional_by"], r["pending"], r["dropped"], r["validation"]) for r in out.collect()} == {i: r[5] for i, r in enumerate(OPTIONALS)}
    assert merge.optional_tally(out).head().asDict() == {"attested": 7, "predicted": 4, "agree": 3, "disagree": 1, "unsplit": 1, "no_text": 1, "no_activation": 1}


def test_displays_and_corrections(spark):
    df = spark.createDataFrame([("f", True, "2026-08-22T12:34:56+0800", 7), (None, True, "x", 123456789), (None, False, None, None)], "c string, r boolean, t string, n long")
    out = df.select(entities.ban_display(F.col("c"), F.col("r")), T.shown_time(F.col("t")), T.padded(F.col("n"))).collect()
    assert [tuple(r) for r in out] == [("f", "2026-08-22 12:34", "00000007"), ("free", "x", "123456789"), ("unreleased", None, None)]
    df = spark.createDataFrame([("abZ", [("a", "ab"), ("c", "Z")]), ("ZZ", [("c", "Z")])], "t string, c array<struct<from:string,to:string>>")
    assert [r[0] for r in df.select(T.reversed_corrections(F.col("t"), F.col("c"))).collect()] == ["ac", None]
