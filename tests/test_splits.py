"""Spans, preambles in two layers, bullets, split records, corrections and cut rules, on small cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from clausewright.functions import spans as S
from clausewright.operators import clauses, splits


def hashed(zh, ja):
    return hashlib.sha1(f"{zh}\x1f{ja}".encode()).hexdigest()[:16]


def test_spans():
    assert S.condensed(" a\nb ") == ("ab", [1, 3])
    assert S.stripped("  ab ", 0, 5) == (2, 4) and S.stripped("a  b", 1, 3) is None
    text = "第一行。\n\n 第二行。尾"
    cut = lambda kind: [text[a:b] for a, b in S.pieces(text, kind)]
    assert cut(S.LINE) == ["第一行。", "第二行。尾"] and cut(S.UNIT) == ["第一行。", "第二行。", "尾"] and cut(S.SENTENCE) == ["第一行。", "第二行。", "尾"]
    assert S.covering("a b\nc", ["ab", "", "c"]) == [(0, 3), None, (4, 5)] and S.covering("abc", ["ab"]) is None and S.covering("", []) == []
    assert S.severed("abcdef", [(0, 3), (3, 6)], ["bc", "cd", "zz", ""]) == ["cd"]
    assert S.quoted("『①』と『甲乙』、『①②』『』") == ["甲乙", ""]


def test_lines_are_joined_where_a_quote_runs_over_the_seam():
    text = "ab\ncd\nef\ngh"
    lines = S.pieces(text, S.LINE)
    assert S.seamed(text, lines, []) == lines
    assert S.seamed(text, lines, ["bc"]) == [(0, 5), (6, 8), (9, 11)]
    assert S.seamed(text, lines, ["bcde"]) == [(0, 8), (9, 11)]
    assert S.seamed(text, lines, ["bc", "de"]) == [(0, 8), (9, 11)]
    assert S.seamed(text, lines, ["cd", "x"]) == lines and S.seamed(text, [], ["x"]) == []


def test_cut_rules():
    text = "甲できる。乙する。丙できる。"
    assert S.cuts(text, "甲|乙|丙") == [5, 9] and S.cuts(text, "甲|乙|丙", "できる") == [5]
    assert S.quotes_cut(text, [5], ["甲できる。乙", "乙する", "無"]) == ["甲できる。乙"]


CASES = {
    # id: (type, zh, ja, supplement, texts of the parts, reason)
    1: (0x21, "素材A+B\n不能特殊召喚。1回合只能使用1次。", "素材A＋B\n特殊召喚できない。１ターンに１度しか使えない。", None, [("素材A+B", "素材A＋B", None), ("不能特殊召喚。", "特殊召喚できない。", "cond"), ("1回合只能使用1次。", "１ターンに１度しか使えない。", "limit")], None),
    2: (0x21, "不能特殊召喚。1回合只能使用1次。", "特殊召喚できない。\n１ターンに１度しか使えない。", "■『特殊召喚できない。１ターンに１度』は", [("不能特殊召喚。1回合只能使用1次。", "特殊召喚できない。\n１ターンに１度しか使えない。", "cond")], None),
    3: (0x21, "甲。乙。", "一。\n二。\n三。", None, [("甲。乙。", "一。\n二。\n三。", None)], "units"),
    4: (0x21, "甲。乙。", "一。二。", None, [("甲。乙。", "一。二。", None)], None),
    5: (0x21, "甲。", "", None, [("甲。", "", None)], None),
    6: (0x21, None, None, None, [(None, None, None)], None),
    7: (0x61, "素材A+B\n不能特殊召喚。", "素材A＋B\n特殊召喚できない。", None, [("素材A+B", "素材A＋B", "mat"), ("不能特殊召喚。", "特殊召喚できない。", "cond")], None),
    8: (0x21, "不能特殊召喚。1回合只能使用1次。", "特殊召喚できない。１ターンに１度しか使えない。", "『できない。１ターン』", [("不能特殊召喚。1回合只能使用1次。", "特殊召喚できない。１ターンに１度しか使えない。", "cond")], None),
}


def test_preambles_by_lines_then_by_role(spark):
    rows = [(i, "main", t, zh, ja, s) for i, (t, zh, ja, s, _, _) in CASES.items()]
    df = spark.createDataFrame(rows, "id long, section string, type long, text_zh string, text_ja string, supplement string")
    got = {}
    for r in clauses.preambles(df).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["label"], r["text_zh"], r["text_ja"], r["role"], r["reason"]))
    for i, (*_, parts, reason) in CASES.items():
        labels = ["0", *(f"0-{k}" for k in range(1, len(parts)))]
        assert got[i] == [(x, *p, reason) for x, p in zip(labels, parts, strict=True)], i


CLAUSE = "id long, section string, label string, text_zh string, text_ja string"


def test_bullets_by_three_authorities(spark):
    lead, ja = "得到以下效果。●一。●二。", "以下の効果を得る。●一。●二。"
    rows = [(i, "main", "①", lead, ja) for i in (1, 2, 3, 4)] + [(5, "main", "①", lead, "以下の効果を得る。●一。"), (1, "main", "0", lead, ja), (6, "main", "①", lead, ja), (7, "main", "①", "甲。●一。●二。", "甲。●一。●二。")]
    said = {
        1: "【『●一。』について】\n■説明です。",
        2: "■１つ目の『●』は誘発効果です。\n■２つ目の『●』は永続効果です。",
        3: "■『●一。』は永続効果です。",
        4: "■説明です。",
        5: "【『●』について】\n■説明です。",
        6: "【『●』について】\n■『一。●二』は続きます。",
        7: "■『●一。』は永続効果です。",
    }
    sup = spark.createDataFrame([(i, "main", "名", s) for i, s in said.items()], "id long, section string, name_ja string, supplement string")
    df = spark.createDataFrame(rows, CLAUSE)
    by = {(r["id"], r["by"]) for r in clauses.bullet_authority(df, sup).collect()}
    assert by >= {(1, "heading"), (2, "typed"), (3, "quoted"), (5, "heading"), (6, "heading")} and {i for i, _ in by} == {1, 2, 3, 5, 6}
    cut, problems = clauses.split_bullets(df, sup)
    got = {}
    for r in cut.collect():
        got.setdefault(r["id"], set()).add((r["label"], r["text_zh"], r["text_ja"]))
    whole = {("①", "得到以下效果。", "以下の効果を得る。"), ("①-●1", "●一。", "●一。"), ("①-●2", "●二。", "●二。")}
    assert got[2] == got[3] == whole and got[1] == whole | {("0", lead, ja)}
    assert got[4] == {("①", lead, ja)} and got[5] == {("①", lead, "以下の効果を得る。●一。")} and got[7] == {("①", "甲。●一。●二。", "甲。●一。●二。")}
    assert {(r["id"], r["problem"]) for r in problems.collect()} == {(5, "bullet_split_mismatch"), (6, "bullet_quote_violations")}


RECORD = "id long, section string, text_hash string, segments array<struct<label:string,text_zh:string,text_ja:string>>, ja_order array<int>"
TEXT = "id long, section string, text_zh string, text_ja string, supplement string, numbered boolean, type long"


def texts(spark, *rows):
    return spark.createDataFrame([(i, "main", zh, ja, sup, numbered, 0x21) for i, zh, ja, sup, numbered in rows], TEXT)


def test_split_records_in_the_order_of_their_checks(spark):
    zh, ja = "前言。 甲。乙。", "まえがき。甲です。乙です。"
    good = [("0", "前言。", "まえがき。"), ("1", "甲。", "甲です。"), ("2", "乙。", "乙です。")]
    h = hashed(zh, ja)
    records = [
        (1, h, good, None),
        (2, h, [], None), (3, None, good, None), (4, h, [("x", zh, ja)], None), (5, h, [("1", "前言。", "まえがき。"), ("1", "甲。乙。", "甲です。乙です。")], None), (6, h, good, [0, 0, 1]),
        (7, "0" * 16, good, None),
        (8, h, [("0", "前言。", "まえがき。"), ("1", "甲。", "甲です。乙です。")], None), (9, h, [("0", "前言。", "まえがき。"), ("1", "甲。乙。", "甲です。")], None),
        (10, h, good, None), (11, h, good, None), (12, h, good, None), (13, h, good, None),
        (14, hashed(zh, "甲です。まえがき。乙です。"), good, [1, 0, 2]),
        (15, h, [("0", "前言。", "まえがき。"), ("0-2", "甲。乙。", "甲です。乙です。")], None),
        (16, h, good, None),
    ]
    df = spark.createDataFrame([(i, "main", x, s, o) for i, x, s, o in records], RECORD)
    sup = {10: "『甲です。乙』は効果です。", 11: "『甲です』は効果です。", 12: "『まえがき。甲です』は効果として扱いません。", 15: "『まえがき。甲です。乙です。』は効果として扱いません。"}
    ja_of = {14: "甲です。まえがき。乙です。"}
    held = texts(spark, *((i, zh, ja_of.get(i, ja), sup.get(i), i == 13) for i, *_ in records if i != 16))
    judged = splits.judged_splits(df, held).cache()
    got = {r["id"]: (r["problem"], r["detail"]) for r in judged.collect()}
    m, q = ("split_malformed", None), "split_quote_violations"
    assert got == {
        1: (None, None), 2: m, 3: m, 4: m, 5: m, 6: m, 7: ("split_stale", None), 8: ("split_coverage_failed", "zh"), 9: ("split_coverage_failed", "ja"), 10: (q, "甲です。乙"), 11: (None, None),
        12: (q, "まえがき。甲です"), 13: ("split_unused", None), 14: (None, None), 15: (None, None), 16: ("split_unused", None),
    }
    out = [tuple(r[c] for c in ("pos", "label", "text_zh", "text_ja", "kind", "source")) for r in splits.split_clauses(judged.where("id = 14")).orderBy("pos").collect()]
    assert out == [(0, "0", "前言。", "まえがき。", "x", "rule"), (1, "1", "甲。", "甲です。", None, None), (2, "2", "乙。", "乙です。", None, None)]
    assert splits.split_problems(judged).count() == 12
    # A quote that the text says is no effect may be cut where it is a run of whole preambles.
    two = [("0", "前言。", "まえがき。"), ("0-2", "甲。", "甲です。"), ("1", "乙。", "乙です。")]
    excused = splits.judged_splits(spark.createDataFrame([(1, "main", h, two, None)], RECORD), texts(spark, (1, zh, ja, "『まえがき。甲です。』は効果として扱いません。", False)))
    assert excused.head()["problem"] is None


def test_records_of_judgments(spark):
    blobs = spark.createDataFrame([(1, "main", "甲。", "一。"), (2, "main", "乙。", "二。")], "id long, section string, text_zh string, text_ja string")
    part = [("1", "甲。", "一。")]
    results = spark.createDataFrame([(1, "main", True, None, part, None), (2, "main", True, "cannot", [], None), (3, "main", True, None, part, None), (2, "pendulum", True, None, [], None), (4, "main", None, None, part, None)], "id long, section string, split boolean, note string, clauses array<struct<label:string,text_zh:string,text_ja:string>>, ja_order array<int>")
    records, rest = splits.records_of_judgments(results, blobs, "t1")
    assert [(r["id"], r["text_hash"], r["ticket"]) for r in records.collect()] == [(1, hashed("甲。", "一。"), "t1")]
    assert {(r["id"], r["section"], r["reason"]) for r in rest.collect()} == {(2, "main", "skipped"), (3, "main", "not_open"), (2, "pendulum", "not_open")}
    events = spark.createDataFrame([(1, "main", "judgment_rejudge_refused"), (2, "main", None)], "id long, section string, event string")
    orphans = spark.createDataFrame([(9, "main")], "id long, section string")
    judged = splits.judged_splits(records.drop("ticket"), texts(spark, (1, "別。", "一。", None, False)))
    assert {(r["check"], r["id"]) for r in splits.refused(records, judged, orphans, events).collect()} == {("split_stale", 1), ("judgment_orphans", 9), ("judgment_rejudge_refused", 1)}


def test_corrections_are_synced_once(spark):
    good = [("0", "前言。", "まえがき。"), ("1", "甲錯字。", "甲です。")]
    h = hashed("前言。甲錯字。", "まえがき。甲です。")
    rows = [(1, h, good, None), (2, "0" * 16, good, None), (3, h, good, [0, 5]), (4, h, good, None), (5, hashed("前錯。錯甲。", "一二"), [("0", "前錯。", "一"), ("1", "錯甲。", "二")], None)]
    df = spark.createDataFrame([(i, "main", x, s, o) for i, x, s, o in rows], RECORD)
    fixes = spark.createDataFrame([(1, "錯字", "正字"), (2, "錯字", "正字"), (3, "錯字", "正字"), (5, "錯", "正"), (9, "a", "b")], "id long, from string, to string")
    once, problems = splits.synced_records(df, fixes)
    got = {r["id"]: (r["text_hash"], [s["text_zh"] for s in r["segments"]]) for r in once.collect()}
    assert got[1] == (hashed("前言。甲正字。", "まえがき。甲です。"), ["前言。", "甲正字。"]) and got[4] == (h, ["前言。", "甲錯字。"])
    assert {(r["id"], r["reason"]) for r in problems.collect()} == {(2, "hash_mismatch"), (3, "bad_order"), (5, "ambiguous")}
    twice, _ = splits.synced_records(once.where("id = 1"), fixes)
    assert twice.collect() == once.where("id = 1").collect()
    sheet = spark.createDataFrame([(1, "甲錯字。", "", "old"), (1, "無關。", "無関", "old"), (7, "甲錯字。", "", "old")], "id long, text_zh string, text_ja string, text_hash string")
    done = [tuple(r) for r in splits.synced_clauses(sheet, fixes).orderBy("id", "text_zh").collect()]
    assert done == [(1, "無關。", "無関", "old"), (1, "甲正字。", "", hashlib.sha1("甲正字。".encode()).hexdigest()[:16]), (7, "甲錯字。", "", "old")]


@pytest.mark.parametrize("exception,n", [(None, 2), ("できる", 1)])
def test_a_cut_rule_against_quotes(spark, exception, n):
    df = spark.createDataFrame([(1, "main", "甲できる。乙する。丙できる。", "『甲できる。乙する』"), (2, "main", "無し", None)], "id long, section string, text_ja string, supplement string")
    got = splits.cut_rule_violations(df, "乙|丙", exception).select("id", "n_cuts", F.array_join("quotes", "|").alias("q")).collect()
    assert [tuple(r) for r in got] == [(1, n, "甲できる。乙する")]


def test_batches_of_texts_are_bounded_by_bytes(spark):
    from clausewright.plans import lineage

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(1 << 30))
    records = spark.createDataFrame([], "id long, section string, text_hash string, segments array<struct<label:string,text_zh:string,text_ja:string>>, ja_order array<int>")
    texts = spark.createDataFrame([], "id long, section string, text_zh string, text_ja string, supplement string, numbered boolean, type long")
    splits.judged_splits(records, texts)
    assert int(spark.conf.get(name)) == lineage.BATCH
