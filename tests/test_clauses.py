"""Clauses from entity texts."""

from clausewright.operators import attest, clauses


def test_build(spark):
    entities = spark.createDataFrame(
        [
            (1, 0x1 | 0x2000, "協調怪獸＋其他\n此卡不能通常召喚。\n1回合只能使用1次。\n①：抽1張。\n●甲。\n●乙。\n②：破壞。", "チューナー\n①：引く。●甲。●乙。\n②：壊す。", None),
            (2, 0x1, "x【靈擺效果】①：甲。【怪獸敘述】故事", None, "①：甲！"),
            (3, 0x2, "整團。", "塊。", None),
        ],
        "id long, type long, body string, ja_main string, ja_pendulum string",
    )
    said = spark.createDataFrame([(1, "main", "n", "【『●甲』の効果について】\n永続効果です。")], "id long, section string, name_ja string, supplement string")
    out = clauses.build(entities, clauses.bullets_spoken_of(said))
    got = {(r["id"], r["section"], r["label"]): (r["text_zh"], r["text_ja"], r["role"], r["unsplit"]) for r in out.collect()}
    assert got == {
        (1, "main", "0"): ("協調怪獸＋其他", None, "mat", False),
        (1, "main", "0-1"): ("此卡不能通常召喚。", None, "cond", False),
        (1, "main", "0-2"): ("1回合只能使用1次。", None, "limit", False),
        (1, "main", "①"): ("①：抽1張。", "①：引く。", None, False),
        (1, "main", "①-●1"): ("●甲。", "●甲。", None, False),
        (1, "main", "①-●2"): ("●乙。", "●乙。", None, False),
        (1, "main", "②"): ("②：破壞。", "②：壊す。", None, False),
        (2, "pendulum", "①"): ("①：甲。", "①：甲！", None, False),
        (3, "main", "1"): ("整團。", "塊。", None, True),
    }
    assert clauses.substring_faults(out, entities).count() == 0
    assigned, _ = attest.attest(said, out)
    assert [(r["label"], r["kind"]) for r in assigned.collect()] == [("①-●1", "c")]


def test_faults_in_any_order(spark):
    body = "甲 乙\n丙丁。戊"
    parts = ["丙丁。", "甲乙", "乙丙", "無", "", "戊", None]
    rows = spark.createDataFrame([(1, str(i), p) for i, p in enumerate(parts)] + [(2, "0", "甲"), (3, "0", "甲")], "id long, label string, text_zh string")
    entities = spark.createDataFrame([(1, body), (2, None)], "id long, body string")
    assert [tuple(r) for r in clauses.substring_faults(rows, entities).collect()] == [(1, "3", "無")]


def test_preambles_are_dealt_to_all_tasks(spark):
    texts = spark.createDataFrame([(1, "main", 0x21, "甲。", "甲。", None)], "id long, section string, type long, text_zh string, text_ja string, supplement string").coalesce(1)
    cut = clauses.preambles(texts)
    assert "REPARTITION_BY_COL" in cut._jdf.queryExecution().toString() and cut.count() == 1
