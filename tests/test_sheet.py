"""The whole sheet in one build, and later runs that make only changed entities anew."""

import hashlib

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import sheet

EFFECT, PLAIN, SPELL = 0x21, 0x11, 0x2
ENTITIES = [
    (1, EFFECT | 0x2000, "協調怪獸＋其他\n①：抽1張。\n②：破壞。\n\n※別名", "ア"),
    (2, EFFECT, "①：選。●甲。●乙。", "イ"),
    (3, SPELL, "整團。古い。", "ウ"),
    (4, PLAIN, "只是故事。", "エ"),
    (5, EFFECT, "①：甲。②：乙。", "オ"),
    (6, EFFECT, "①：一。\n①：二。", "カ"),
    (7, SPELL, "前半。後半。", "キ"),
    (8, EFFECT, "①：無日文。", None),
    (None, EFFECT, "①：無號。", None),
]
SUPPLEMENTS = [
    (1, "main", "チューナー＋他\n①：カードを１枚ドローできる。\n②：破壊する。", "『①』は誘発効果です。\n『②』は必ず発動する効果です。"),
    (2, "main", "①：選ぶ。●攻撃する。●守備する。", "【『●攻撃』の効果について】\n永続効果です。"),
    (3, "main", "塊。古い。", ""),
    (5, "main", "①：甲する。", "『①』は起動効果です。"),
    (6, "main", "①：一。\n②：二。", None),
    (7, "main", "前。後。", "x"),
]
JUDGMENTS = [
    (1, "main", "①", 1, "q", "o", None), (1, "main", "②", 1, "q", None, None), (2, "main", "①-●2", 1, "c", None, None), (3, "main", "1", 1, None, None, None),
    (6, "main", "②", 1, "t", "o", None), (9, "main", "①", 1, "t", None, None), (7, "main", "2", 1, "sn", "m", None),
]
SCHEMAS = (
    "id long, type long, body string, name_ja string",
    "id long, section string, text_ja string, supplement string",
    "id long, section string, label string, seq long, kind string, optional string, role string",
)


def frames(spark, entities=ENTITIES, supplements=SUPPLEMENTS, judgments=JUDGMENTS):
    found = [spark.createDataFrame(rows, schema) for rows, schema in zip((entities, supplements, judgments), SCHEMAS, strict=True)]
    parts = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(zh).alias("text_zh"), F.lit(ja).alias("text_ja")) for n, zh, ja in (("1", "前半。", "前。"), ("2", "後半。", "後。"))))
    records = spark.range(1).select(F.lit(7).cast("long").alias("id"), F.lit("main").alias("section"), T.split_hash(F.lit("前半。後半。"), F.lit("前。後。")).alias("text_hash"), parts.alias("segments"), F.lit(None).cast("array<int>").alias("ja_order"))
    records = records.unionByName(records.withColumn("id", F.lit(5).cast("long")))  # of a numbered text
    return {"entities": found[0], "supplements": found[1], "records": records, "judgments": found[2]}


def rows(built):
    return {(r["id"], r["section"], r["label"]): r.asDict() for r in built.clauses.collect()}


def touched(built):
    return sorted(r["id"] for r in built.touched.collect())


@pytest.fixture(scope="module")
def first(spark):
    return sheet.build_sheet(**frames(spark))


def test_first_build(first):
    got = {k[::2]: (r["text_zh"], r["text_ja"], r["kind"], r["optional"], r["role"], r["source"], r["needs_review"]) for k, r in rows(first).items()}
    assert got == {
        (1, "0"): ("協調怪獸＋其他", "チューナー＋他", "x", None, "mat", "rule", True),
        (1, "①"): ("①：抽1張。", "①：カードを１枚ドローできる。", "q", "o", None, "llm", True),
        (1, "②"): ("②：破壞。", "②：破壊する。", "q", "m", None, "llm", True),
        (2, "①"): ("①：選。", "①：選ぶ。", None, None, None, None, False),
        (2, "①-●1"): ("●甲。", "●攻撃する。", "c", None, None, "official", False),
        (2, "①-●2"): ("●乙。", "●守備する。", "c", None, None, "llm", False),
        (3, "1"): ("整團。古い。", "塊。古い。", None, None, None, None, False),
        (5, "①"): ("①：甲。", "", "i", None, None, "official", False),
        (5, "②"): ("②：乙。", "", None, None, None, None, False),
        (6, "①"): ("①：一。", "①：一。", None, None, None, None, False),
        (6, "②"): ("①：二。", "②：二。", "t", "o", None, "llm", False),
        (7, "1"): ("前半。", "前。", None, None, None, None, False),
        (7, "2"): ("後半。", "後。", "sn", "m", None, "llm", False),
        (8, "①"): ("①：無日文。", "", None, None, None, None, False),
    }
    assert {k[0] for k, r in rows(first).items() if r["confidence"] == "high"} == {1, 2, 5, 7}
    said = {(r["id"], r["label"], r["check"]) for r in first.report.collect()}
    assert said >= {
        (1, "①", "late_official_conflict"), (3, "1", "judgment_blank"), (3, "1", "pending_split"), (5, None, "numeral_mismatch"), (6, None, "numeral_relabelled"),
        (8, None, "no_japanese_text"), (9, "①", "judgment_orphans"), (5, None, "split_unused"),
    }
    assert touched(first) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_a_run_on_its_own_output_changes_nothing(spark, first):
    again = sheet.build_sheet(**frames(spark), prior=first)
    assert touched(again) == [] and rows(again) == rows(first)
    assert sorted(map(repr, again.report.collect())) == sorted(map(repr, first.report.collect()))
    # ... nor does one that makes every entity anew
    bare = sheet.Sheet(first.clauses, first.report, first.stamps.where("false"), first.touched)
    whole = sheet.build_sheet(**frames(spark), prior=bare)
    assert touched(whole) == [1, 2, 3, 4, 5, 6, 7, 8] and rows(whole) == rows(first)


def test_one_changed_text_makes_one_entity_anew(spark, first):
    changed = [(i, t, b.replace("乙", "丙") if i == 2 else b, n) for i, t, b, n in ENTITIES if i != 8] + [(10, EFFECT, "①：新。", None)]
    again = sheet.build_sheet(**frames(spark, entities=changed), prior=first)
    assert touched(again) == [2, 10]
    now, before = rows(again), rows(first)
    assert {k: r for k, r in now.items() if k[0] not in (2, 10)} == {k: r for k, r in before.items() if k[0] not in (2, 8)}
    assert now[2, "main", "①-●2"]["text_zh"] == "●丙。" and now[10, "main", "①"]["kind"] is None
    # what was judged stays; the text that was judged is another now only where the original changed
    assert (now[2, "main", "①-●2"]["kind"], now[2, "main", "①-●2"]["source"]) == ("c", "llm")


def test_official_texts_records_and_judgments_touch_their_entities(spark, first):
    later = [(*r[:3], "『①』は誘発効果です。") if r[0] == 6 else r for r in SUPPLEMENTS]
    judged = [*JUDGMENTS, (7, "main", "1", 1, "sn", None, None)]
    again = sheet.build_sheet(**frames(spark, supplements=later, judgments=judged), prior=first)
    assert touched(again) == [6, 7]
    now = rows(again)
    assert (now[6, "main", "①"]["kind"], now[6, "main", "①"]["source"]) == ("t", "official")
    assert (now[7, "main", "1"]["kind"], now[7, "main", "1"]["source"]) == ("sn", "llm")


def test_stored_rows_whose_clause_is_gone_are_reported(spark, first):
    shorter = [(i, t, "①：選。" if i == 2 else b, n) for i, t, b, n in ENTITIES]
    again = sheet.build_sheet(**frames(spark, entities=shorter), prior=first)
    lost = {(r["id"], r["label"]) for r in again.report.where("check = 'orphaned'").collect()}
    assert lost == {(2, "①-●1"), (2, "①-●2")} and touched(again) == [2]


def test_rules_speak_of_stored_rows_again(spark):
    texts = [(i, "main", f"①：相手がモンスターの効果を発動した時に発動できる。{i}", None) for i in range(4)]
    entities = [(i, EFFECT, f"①：{i}。", None) for i in range(4)]
    judged = [(i, "main", "①", 1, kind, None, None) for i, kind in enumerate(("q", "t", "q"))]
    built = sheet.build_sheet(**(frames(spark, entities[:2], texts[:2], judged) | {"records": None}), least=3)
    assert {r["predicted"] for r in rows(built).values()} == {None}
    grown = sheet.build_sheet(**(frames(spark, entities, texts, judged) | {"records": None}), prior=built, least=3)
    assert touched(grown) == [2, 3]
    hits = {tuple(r["hits"]) for r in rows(grown).values()}
    predicted = {r["predicted"] for r in rows(grown).values()}
    assert len(hits) == 1 and len(predicted) == 1
    if predicted != {None}:
        assert {r["source"] for r in rows(grown).values() if r["kind"] == r["predicted"]} == {"llm_then_rule"}


def test_no_entities(spark):
    built = sheet.build_sheet(**frames(spark, [], [], []))
    assert built.clauses.count() == 0 and built.clauses.columns == list(sheet.COLUMNS)


def test_texts_are_stored_once(spark, tmp_path):
    """Of both languages' texts, a build leaves about what they take, not a copy a step."""
    entities = [(i, EFFECT, "".join(f"①：{hashlib.sha256(f'{i} {k}'.encode()).hexdigest()}\n" for k in range(300)), "名") for i in range(20)]
    supplements = [(i, "main", b.replace("a", "g"), "『①』は誘発効果です。") for i, _, b, _ in entities]
    size = sum(len(e[2]) for e in entities) + sum(len(s[2]) for s in supplements)
    context = spark.sparkContext
    before = context._jsc.sc().getCheckpointDir().get()
    context.setCheckpointDir(str(tmp_path))
    try:
        built = sheet.build_sheet(**(frames(spark, entities, supplements, []) | {"records": None}))
        assert built.clauses.count() == 6000
    finally:
        context._jsc.sc().setCheckpointDir(before)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < 1.5 * size


def test_texts_are_packed_where_both_languages_meet(spark):
    """Of the two texts of each section, the shuffle takes what they take compressed; odd texts come out as they went in."""
    body = lambda i: "".join(f"①：{hashlib.sha256(f'{i} {k}'.encode()).hexdigest()}\n" for k in range(200))
    odd = ["", "\x00", "é😀", " \n "]
    entities = spark.createDataFrame([(i, EFFECT, odd[i] if i < 4 else body(i)) for i in range(60)] + [(99, EFFECT, None)], "id long, type long, body string")
    told = spark.createDataFrame([(i, "main", odd[i] if i < 4 else body(-i), None) for i in range(59)], "id long, section string, text_ja string, supplement string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        got = {r["id"]: (r["zh"].strip(), r["ja"]) for r in sheet.sections(entities, told).collect()}
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {i: ((odd[i] if i < 4 else body(i)).strip(), (odd[i] if i < 4 else body(-i)) if i < 59 else "") for i in range(60)} | {99: ("", "")}
    assert moved < 0.75 * sum(len(body(i)) for i in range(4, 60)) * 2
