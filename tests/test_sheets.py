"""Work batches, blind samples, index checks and the joins around official entries, on small cases."""

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.functions import vocab as V
from clausewright.operators import batches, census, checks, entities, joins, merge, rules, sampling

CLAUSES = "id long, section string, pos int, label string, text_zh string, text_ja string, kind string, optional string, role string, source string, rule_predicted string"


def sheet(spark, *rows):
    return spark.createDataFrame([(i, sec, pos, label, f"zh{label}", ja, kind, None, None, source, None) for i, sec, pos, label, ja, kind, source in rows], CLAUSES)


@pytest.fixture(scope="module")
def clauses(spark):
    return sheet(
        spark,
        (1, "main", 0, "0", "前", "x", "rule"), (1, "main", 1, "①", "甲です", None, None), (1, "main", 2, "②", "乙です", "t", "official"),
        (2, "main", 0, "1", "丙です", "c", "official"), (3, "pendulum", 0, "①", "丁です", "i", "llm"), (3, "main", 1, "0", "一", "x", "rule"), (3, "main", 2, "0-1", "二", "x", "rule"), (3, "main", 3, "①", "三", "q", "official"),
    ).cache()


@pytest.fixture(scope="module")
def cards(spark):
    rows = [(1, 0x21, "一", "いち", "本文\n\n※別名"), (2, 0x10002, "二", None, "甲"), (3, 0x1000021, "三", "さん", None), (4, 0x4, "四", None, "")]
    return spark.createDataFrame(rows, "id long, type long, name_zh string, name_ja string, body string").cache()


@pytest.fixture(scope="module")
def supplements(spark):
    rows = [(1, "名一", "カード", "■『甲です』は誘発効果です。『①』『甲です』", None, None), (2, "名二", "丙です", None, "", ""), (3, None, "三", "主", "ペン", "振り子の『丁です』")]
    return spark.createDataFrame(rows, "id long, name_ja string, card_text string, supplement string, pen_effect string, pen_supplement string").cache()


def test_batches(spark, clauses, cards, supplements):
    assert [r["label"] for r in batches.pending(clauses).collect()] == ["①"]
    assert {r["id"] for r in batches.only(cards, [1, 3, 3]).collect()} == {1, 3}
    with pytest.raises(KeyError, match="7, 9"):
        batches.only(cards, [9, 1, 7])
    context = batches.contexts(cards, supplements)
    got = {r["id"]: r for r in context.collect()}
    assert got[1]["card_text_zh"] == "本文" and got[1]["name_ja"] == "いち" and got[2]["name_ja"] == "名二" and got[1]["pendulum"] is None and got[3]["pendulum"]["supplement"] == "振り子の『丁です』"
    assert [got[i]["card_type"] for i in (1, 2, 3, 4)] == ["怪獸", "速攻魔法", "怪獸", "通常陷阱"]
    blobs = spark.createDataFrame([(2, "main", "丙", "丙です"), (3, "pendulum", "丁", "丁です")], "id long, section string, text_zh string, text_ja string")
    work = {r["id"]: r for r in batches.payloads(clauses, blobs, context).collect()}
    assert {i: r["series"] for i, r in work.items()} == {1: "kind", 2: "split", 3: "split"}
    assert [c["label"] for c in work[1]["clauses"]] == ["①"] and work[2]["clauses"] == [] and work[3]["split_targets"][0]["hints"] == ["丁です"] and work[2]["split_targets"][0]["hints"] == []
    assert {(r["id"], r["batch"]) for r in batches.batched(batches.payloads(clauses, blobs, context)).collect()} == {(1, 1), (2, 1), (3, 1)}
    numbered = batches.numbered_batches(cards, 3, F.col("id"))
    assert sorted((r["id"], r["batch"]) for r in numbered.collect()) == [(1, 1), (2, 1), (3, 1), (4, 2)]


def test_rejudgments(clauses, cards, supplements):
    assert batches.parse_keys("1:main:②, 3:pendulum:①") == [(1, "main", "②"), (3, "pendulum", "①")] and batches.parse_keys("1:other:②") is None and batches.parse_keys("1:main:") is None
    context = batches.contexts(cards, supplements)
    got = {r["id"]: r["clauses"] for r in batches.rejudgments(clauses, context, [(1, "main", "②"), (3, "main", "①")]).collect()}
    assert got[1][0]["rejudge"] and got[1][0]["current"].asDict() == {"kind": "t", "optional": None, "role": None, "source": "official"} and len(got[3]) == 1
    with pytest.raises(KeyError, match=r"1:main:①: not judged yet; 8:main:①: no such clause"):
        batches.rejudgments(clauses, context, [(8, "main", "①"), (1, "main", "①")])


def test_blind_rows(spark, clauses, cards, supplements):
    kinds = ["t", "c", "q", "i"]
    excluded = sampling.excluded_ids(spark.createDataFrame([(2, "x")], "id int, y string"), ids=[9, 2])
    assert sorted(r["id"] for r in excluded.collect()) == [2, 9]
    assert {(r["id"], r["label"]) for r in sampling.candidates(clauses, kinds, excluded).collect()} == {(1, "②"), (3, "①")}
    assert {(r["id"], r["section"]): r["preamble"] for r in sampling.preamble_contexts(clauses).collect()} == {(1, "main"): "前", (3, "main"): "一\n二"}
    rows = {(r["id"], r["section"], r["label"]): r for r in sampling.blind_rows(clauses, clauses, cards, supplements).collect()}
    assert rows[3, "main", "①"]["preamble"] == "一\n二" and rows[3, "main", "0-1"]["preamble"] == "" and rows[3, "pendulum", "①"]["preamble"] == ""
    assert rows[3, "pendulum", "①"]["supplement"] == "振り子の『丁です』" and rows[1, "main", "②"]["supplement"] == "『①』『甲です』"
    assert rows[1, "main", "②"]["name_ja"] == "名一" and rows[3, "main", "①"]["name_ja"] == "さん"
    assert {(r["id"], r["label"], r["kind"]) for r in sampling.answer_key(clauses, ["id", "label"]).where("id < 3").collect()} == {(1, "0", None), (1, "①", None), (1, "②", "t"), (2, "1", "c")}


@pytest.mark.parametrize(
    "text,wanted",
    [
        (None, ""), ("", ""), ("【①の効果について】\n■誘発効果です。", "【①の効果について】"), ("■残る文。永続効果です。次の文", "■残る文。次の文"), ("甲（乙。必ず発動します。）", "甲（乙。）"),
        ("（誘発効果です。甲。）", "甲。"), ("必ず発動します。））", ""), ("甲。\n\n 乙。 ", "甲。\n乙。"), ("■効果として扱いません。", ""),
    ],
)
def test_conclusions_are_masked(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sampling.without_conclusions(F.col("t"))).head()[0] == wanted


def test_scores_of_blind_rows(spark):
    keys = ["id", "label"]
    sample = spark.createDataFrame([(i, "①", f"t{i}") for i in range(1, 11)], "id long, label string, text string")
    now = [(1, "t1", "t", "official"), (2, "other", "t", "official"), (3, "t3", "t", "llm"), (4, "t4", "u", "official"), (5, "t5", "t", "official"), (6, "t6", "t", "official"), (7, "t7", "c", "official"), (9, "t9", "t", "official"), (10, "t10", "t", "official")]
    now = spark.createDataFrame([(i, "①", *r) for i, *r in now], "id long, label string, text string, kind string, source string")
    answers = spark.createDataFrame([(1, "①", "t"), (2, "①", "t"), (4, "①", "t"), (5, "①", "c"), (6, "①", "zz"), (9, "①", None), (99, "①", "t")], "id long, label string, kind string")
    out = [spark.createDataFrame([(i, "①")], "id long, label string") for i in (7, 98)]
    got = {r["id"]: r["status"] for r in sampling.score(sample, answers, now, keys, ["t", "c"], ambiguous=out[0], pipeline=out[1]).collect()}
    assert got == {1: "right", 2: "stale", 3: "withdrawn", 4: "withdrawn", 5: "wrong", 6: "invalid", 7: "ambiguous", 8: "stale", 9: "blank", 10: "missing", 98: "unknown", 99: "extra"}
    scored = sampling.score(sample, answers, now, keys, ["t", "c"], ambiguous=out[0])
    assert tuple(sampling.overall(scored).head()) == (3, 1, 1 / 3) and not sampling.passed(scored)
    fine = sampling.score(sample.where("id IN (1, 3)"), answers.where("id = 1"), now, keys, ["t", "c"])
    assert sampling.passed(fine) and not sampling.passed(sampling.score(sample.where("id IN (1, 7)"), answers.where("id = 1"), now, keys, ["t", "c"], ambiguous=out[0]))
    assert not sampling.passed(fine.limit(0)) and sampling.overall(fine.limit(0)).head()["accuracy"] is None


def test_hot_classes_are_sampled_as_a_whole_sort_would(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4900, "hot").otherwise("rare").alias("c"))
    got = sampling.stratified(rows, "c", {"hot": 30, "rare": 200, "none": 5}, 3, "id")
    order = rows.where("c = 'hot'").orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(30)
    assert {r["id"] for r in got.where("c = 'hot'").collect()} == {r["id"] for r in order.collect()} and got.where("c = 'rare'").count() == 100 and got.columns == ["c", "id"]


INDEX = "id long, body string, alias string, cat string, subs array<string>, attr string, race string, markers array<string>, rarity string, region string, ban_o string, ban_t string, ban_m string, clauses array<struct<label:string,text:string,kind:string,opt:string,role:string>>"


def test_index_checks(spark):
    row = lambda i, body, alias, cl, **k: {"id": i, "body": body, "alias": alias, "cat": "m", "subs": ["effect"], "clauses": cl, **k}
    one = ("①", "甲 乙。", "t", "m", None)
    rows = [
        row(1, "【怪獸效果】\n甲\n乙。\n※別名", "別名", [one]), row(2, "丙甲乙。", None, [one]), row(3, "丁。", None, [one, ("②", "丁。", "c", "m", "mat")]),
        row(4, "甲乙。\n※別名", None, [one]), row(5, "甲乙。", "別名", [("①", "甲乙。", "zz", None, None)], attr="nope", subs=["effect", "token"], markers=["TL", "??"]), row(6, "【怪獸敘述】故事", None, [], cat="s", subs=["quick"]),
    ]
    index = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in INDEX.split(", ")) for r in rows], INDEX)
    kinds = index.sparkSession.createDataFrame([("【怪獸效果】",), ("【靈擺效果】\n【怪獸敘述】",), ("※甲",), ("【怪獸效果】※甲",), ("別的",)], "g string").select(checks.gap_kind(F.col("g"))).collect()
    assert [r[0] for r in kinds] == ["header", "header", "alias", "alias", None]
    faults = {(r["check"], r["id"], r["detail"]) for r in checks.coverage_faults(index, entities.flavor(F.col("body"), F.size("clauses") > 0)).collect()}
    assert faults == {("coverage_gaps", 2, "丙"), ("clauses_not_in_text", 3, "甲乙。"), ("alias_gap_not_extracted", 4, ""), ("alias_gap_not_extracted", 5, "別名")}
    assert {(r["id"], r["detail"]) for r in checks.unexported(index).collect()} == {(5, "attr:nope"), (5, "subs:token"), (5, "markers:??"), (5, "kind:zz")}
    assert {(r["id"], r["detail"]) for r in checks.optional_off_carriers(index).collect()} == {(3, "②")}
    decoded = spark.createDataFrame([(1, 0x21, 1, 1, 0), (2, 0x21, 0, 1, 0), (3, 0x2, 0, 0, 5), (7, 0x40000000 | 0x21, 3, 1, 0), (7, 0x21, 1, 1, 0)], "id long, type long, race long, attribute long, level long").withColumns({"atk": F.lit(0), "def": F.lit(0)})
    found = checks.index_problems(decoded, index, spark.createDataFrame([(1,), (2,), (3,)], "id long"), entities.flavor(F.col("body"), F.size("clauses") > 0))
    got = {(r["check"], r["id"]) for r in found.collect()}
    assert got >= {("monster_without_parameters", 2), ("parameters_without_monster", 3), ("unexplained_type_bits", 7), ("unknown_race", 7), ("missing_from_index", 7), ("duplicate_id", 7), ("without_clause_entry", 7), ("optional_on_non_carrier", 3), ("not_exported", 5)}
    with pytest.raises(checks.CheckFailed, match="duplicate_id: 1"):
        checks.require(found)
    checks.require(checks.vocabulary_problems(spark, V.problems()))
    with pytest.raises(checks.CheckFailed, match="vocabulary"):
        checks.require(checks.vocabulary_problems(spark, ["x"]))
    with pytest.raises(checks.CheckFailed, match="unknown_race: 1"):
        checks.known_values(decoded, {"race": V.RACE})


def test_buttons_without_entities_go():
    exported = V.export()
    codes = [c for g in exported["kind"]["groups"] for c in g["codes"]]
    group = exported["kind"]["groups"][-1]["codes"]
    left = checks.pruned(exported, dict.fromkeys(group, 0) | {codes[0]: 3})
    assert [c for g in left["kind"]["groups"] for c in g["codes"]] == [c for c in codes if c not in group] and left["kind"]["items"] == exported["kind"]["items"] and exported["kind"]["groups"][-1]["codes"] == group


def test_seal(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "id long, v string")
    found = spark.createDataFrame([("pending", 1, "")], "check string, id long, detail string")
    got = {r["gate"]: (r["ok"], r["n"]) for r in checks.sealed(found, a, b, ["id"]).collect()}
    assert len(got) == len(checks.CONVERGED) + len(checks.INTEGRITY) + 2 and got["pending"] == (False, 1) and got["fixpoint"] == (False, 2) and got["unique_keys"] == (True, 0) and got["split_stale"] == (True, 0)
    assert all(r["ok"] for r in checks.sealed(found.limit(0), a, a, ["id"]).collect())


def test_entities_for_display(spark):
    df = spark.createDataFrame([(1, "f", None, None, "o", None), (2, None, "l", None, "t", "UR"), (3, None, None, None, "b", "N")], "id long, ban_o string, ban_t string, ban_m string, region string, rarity string")
    got = {r["id"]: r["b"] for r in df.select("id", entities.ban_row().alias("b")).collect()}
    assert got[1].asDict() == {"ban_o": "f", "ban_t": "unreleased", "ban_m": "unreleased"} and got[2].asDict() == {"ban_o": "unreleased", "ban_t": "l", "ban_m": "free"} and got[3] is None
    cards, counts = entities.named(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "n")], "id long, name string"), "name_zh")
    assert sorted(map(tuple, cards.collect())) == [(1, "n"), (2, "")] and tuple(counts.head()) == (1, 1)
    assert {tuple(r) for r in entities.coverage_counts(cards, "name_zh", "id").collect()} == {("name_zh", 1, 1), ("id", 2, 0)}
    meta = entities.metadata(spark.createDataFrame([(1, [1, 2]), (2, [])], "id long, clauses array<int>"), "now", {"a": "h"}).head()
    assert (meta["cards"], meta["clauses"], meta["vocab_digest"], meta["sources"]) == (2, 2, V.digest(), {"a": "h"}) and "data_updated_at" not in meta


def test_joins_around_official_entries(spark):
    left = spark.createDataFrame([(1, [11], 3), (2, [22], 2), (3, None, 3)], "id long, alt_ids array<long>, ot int")
    ocg = spark.createDataFrame([(1, "f"), (11, "l"), (22, "s"), (9, "f")], "id long, v string")
    rows, unused = joins.consuming_lookup(left, "id", "alt_ids", {"bo": ocg, "bt": ocg.where("id = 9")}, "v")
    assert {(r["id"], r["bo"], r["bt"]) for r in rows.collect()} == {(1, "f", None), (2, "s", None), (3, None, None)}
    assert {tuple(r) for r in unused.collect()} == {("bo", 11), ("bo", 9), ("bt", 9)}
    covered = spark.createDataFrame([(11,), (None,)], "password long")
    missing, elsewhere = joins.missing_by_region(left, covered, "password")
    assert [r["id"] for r in missing.collect()] == [3] and [r["id"] for r in elsewhere.collect()] == [2]
    assert joins.coverage_report(left, covered, "password") == ["without an entry: 1; of another region: 1", "  3", "  they can be fetched again"] and len(joins.coverage_report(left, None, "password")) == 1
    targets, rest = joins.resolved(left, spark.createDataFrame([(22, 5), (1, 6)], "id long, cid int"), "cid")
    assert {(r["id"], r["cid"]) for r in targets.collect()} == {(1, 6), (2, 5)} and [r["id"] for r in rest.collect()] == [3]
    ok, bad = joins.verified(left, spark.createDataFrame([(1, ""), (11, "t"), (22, "t")], "password long, card_text string"), "password", "card_text")
    assert [r["id"] for r in ok.collect()] == [2] and sorted(r["id"] for r in bad.collect()) == [1, 3] and ok.columns == left.columns
    old, new = (spark.createDataFrame(x, "cid long, a string, b string") for x in ([(1, "x", None), (2, "x", "y")], [(1, "x", "y"), (2, "x", ""), (3, "", "z")]))
    assert {(r["cid"], tuple(r["gained"])) for r in joins.newly_filled(old, new, "cid", ["b", "a"]).collect()} == {(1, ("b",)), (3, ("b",))}
    dumps = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 2)], "cid long, id long, seq int")
    over = spark.createDataFrame([(2, 21), (4, 40)], "cid long, id long")
    assert {tuple(r) for r in joins.effective_mapping(dumps, over, "cid", "id", [F.col("seq")]).collect()} == {(1, 10), (2, 21), (4, 40)}
    assert {(r["v"], tuple(r["keys"])) for r in joins.inverted(spark.createDataFrame([(3, "a"), (1, "a"), (2, None)], "k long, v string"), "k", "v").collect()} == {("a", (1, 3))}


def test_judgments_to_read_and_attested_kinds(spark, clauses):
    df = spark.createDataFrame([("t", "m", None), (None, None, "mat"), ("", "", "")], "kind string, optional string, role string")
    assert [r[0] for r in df.select(merge.judgment_text(*map(F.col, df.columns))).collect()] == ["t/m", "—/mat", "—"]
    assert df.where(merge.judgment(*map(F.col, df.columns)) == merge.judgment(F.lit("t"), F.lit("m"), F.lit(None).cast("string"))).count() == 1
    assigned = spark.createDataFrame([(1, "main", "①", "q", True), (1, "main", "②", None, True)], "id long, section string, label string, kind string, mandatory boolean")
    got = {r["label"]: (r["kind"], r["source"], r["mandatory"]) for r in merge.attested(clauses.where("id = 1"), assigned).collect()}
    assert got == {"0": ("x", "rule", False), "①": ("q", "official", True), "②": ("t", "official", True)}
    assert {(r["id"], r["label"]) for r in rules.targets(clauses).where("id = 3").collect()} == {(3, "①")} and rules.targets(clauses).count() == 5
    assert rules.stated_digest("指紋 `0123456789abcdef`") == "0123456789abcdef" and rules.stated_digest("none") is None
    said = spark.createDataFrame([("m", None), ("o", None), (None, "no_clause"), (None, "no_word"), ("m", None)], "said string, why string")
    assert {tuple(r) for r in census.tally(said, F.col("said"), "m", F.col("why")).collect()} == {("agree", 2), ("disagree", 1), ("no_clause", 1), ("no_word", 1)}
    assert [r["said"] for r in census.preview(said, 1, F.col("said").desc()).collect()] == ["o"]
    assert {tuple(r) for r in census.census(said.where("said IS NOT NULL"), F.array("said"), ["m", "x"], no_value=True).collect()} == {("m", 2), ("x", 0), (None, 0)}


def test_guarded_mapping(spark):
    diff = joins.mapping_diff(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k long, v string"), "k", "v")
    with pytest.raises(checks.CheckFailed, match="b -> c"):
        checks.guarded_mapping(diff)
    assert checks.guarded_mapping(diff, force=True).count() == 2 and checks.guarded_mapping(diff.where("change = 'added'")).count() == 1


def test_split_hash_joins_both_languages(spark):
    import hashlib

    df = spark.createDataFrame([("甲", "一"), (None, "一")], "zh string, ja string")
    assert [r[0] for r in df.select(T.split_hash(F.col("zh"), F.col("ja"))).collect()] == [hashlib.sha1(x.encode()).hexdigest()[:16] for x in ("甲\x1f一", "\x1f一")]
