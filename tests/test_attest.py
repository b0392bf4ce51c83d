"""The ladder of attributions, a step at a time."""

import hashlib

import pytest

from clausewright.operators import attest

CLAUSES = [
    (1, "main", "0", 0, "チューナー１体", False), (1, "main", "①", 1, "①：カードを１枚ドローする。", False), (1, "main", "②", 2, "②：相手を破壊する。", False),
    (2, "main", "1", 0, "フィールドに存在する限り強い。", False),
    (3, "main", "①", 0, "①：以下から選ぶ。", False), (3, "main", "①-●1", 1, "●攻撃する。", False), (3, "main", "①-●2", 2, "●守備する。", False),
    (4, "main", "1", 0, "整団。古い文。", True),
    (5, "main", "①", 0, "①：このカードは以下の効果を得る。●強くなる。", False),
]

CASES = [
    (1, "『①』は誘発効果です。", ("①", "t", "seq", False), None),
    (1, "『③』は誘発効果です。", None, "seq_missing"),
    (1, "『カードを１枚ドロー』は起動効果です。", ("①", "i", "quote", False), None),
    (1, "『ない文』は起動効果です。", None, "quote_unmatched"),
    (1, "【②の効果について】\n永続効果です。", ("②", "c", "header", False), None),
    (1, "【③の効果について】\n永続効果です。", None, "header_index_missing"),
    (1, "【他】\n永続効果です。", None, "attribution_deferred"),
    (1, "『①』は誘発効果でも永続効果でもなく、分類されない効果です。", ("①", "u", "seq", False), None),
    (1, "『①』は誘発効果です。起動効果です。", None, "kind_ambiguous"),
    (1, "『①』は対象を取る効果ではありません。", None, None),
    (1, "『②』は必ず発動する効果です。", ("②", None, "seq", True), None),
    (1, "『チューナー１体』は効果として扱いません。", ("0", "x", "non_effect", False), None),
    (1, "何も効果として扱いません。", None, "non_effect_outside_preamble"),
    (1, "永続効果です。", None, "attribution_deferred"),
    (2, "「自分」の効果は永続効果です。", ("1", "c", "name_single", False), None),
    (2, "「他人」の効果は永続効果です。", None, "other_card_only"),
    (2, "永続効果です。", ("1", "c", "single", False), None),
    (2, "装備魔法カードの効果として扱います。", ("1", "se", "single", False), None),
    (3, "２つ目の『●』は永続効果です。", ("①-●2", "c", "quote", False), None),
    (3, "【『●攻撃』の効果について】\n起動効果です。", ("①-●1", "i", "header", False), None),
    (4, "『①』は起動効果です。", ("1", "i", "seq", False), None),
    (4, "起動効果です。", None, "attribution_deferred"),
    (5, "『①』は誘発即時効果です。", None, "attribution_deferred"),
    (5, "『このカードは以下の効果』は永続効果です。", ("①", "c", "quote", False), None),
]


@pytest.fixture(scope="module")
def attested(spark):
    clauses = spark.createDataFrame([(100 * n + i, *rest) for n, (case, *_) in enumerate(CASES) for i, *rest in CLAUSES if i == case], "id long, section string, label string, pos int, text_ja string, unsplit boolean")
    supplements = spark.createDataFrame([(100 * n + case, "main", "自分", said) for n, (case, said, *_) in enumerate(CASES)], "id long, section string, name_ja string, supplement string")
    assigned, notes = attest.attest(supplements, clauses)
    return {r["id"]: (r["label"], r["kind"], r["ladder"], r["mandatory"]) for r in assigned.collect()}, {r["id"]: r["note"] for r in notes.collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_step(attested, n):
    case, said, wanted, note = CASES[n]
    assert (attested[0].get(100 * n + case), attested[1].get(100 * n + case)) == (wanted, note), said


def test_both_bullets_and_conflicts(spark):
    clauses = spark.createDataFrame([c for c in CLAUSES if c[0] == 3], "id long, section string, label string, pos int, text_ja string, unsplit boolean")
    said = "どちらの『●』も永続効果です。\n【●について】\n起動効果です。\n１つ目の『●』は誘発効果です。"
    assigned, notes = attest.attest(spark.createDataFrame([(3, "main", "x", said.split("\n【")[0] + "\n１つ目の『●』は誘発効果です。")], "id long, section string, name_ja string, supplement string"), clauses)
    assert [(r["label"], r["kind"]) for r in assigned.collect()] == [("①-●2", "c")]
    assert [(r["note"], r["line"]) for r in notes.collect()] == [("kind_conflicts", "①-●1")]


def test_texts_of_clauses_that_are_named_by_label_are_not_shuffled(spark):
    """Statements by label take labels alone through the shuffle; those by quote still find the texts."""
    text = lambda i, k: "".join(hashlib.sha256(f"{i} {k} {n}".encode()).hexdigest() for n in range(60))
    clauses = [(i, "main", label, k, f"{label}：{text(i, k)}", False) for i in range(100) for k, label in enumerate("①②③")]
    told = [(i, "main", "名", "『②』は誘発効果です。" if i else f"『{text(0, 2)[:40]}』は起動効果です。\n『①』は誘発効果です。") for i in range(100)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    rows = spark.createDataFrame(clauses, "id long, section string, label string, pos long, text_ja string, unsplit boolean")
    assigned, notes = attest.attest(spark.createDataFrame(told, "id long, section string, name_ja string, supplement string"), rows)
    got = {(r["id"], r["label"]): (r["kind"], r["ladder"]) for r in assigned.collect()}
    moved = written() - before
    assert got == {(0, "③"): ("i", "quote"), (0, "①"): ("t", "seq")} | {(i, "②"): ("t", "seq") for i in range(1, 100)} and notes.count() == 0
    assert moved < sum(len(c[4]) for c in clauses) / 4
