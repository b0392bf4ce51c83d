"""What the operators must hold where rows are odd: repeated ids, clashing names, very long words."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import bpe, minhash, mixing, quantisation, queries, secrets, url_filter

FOLDER = "/root/testdata/sf0.001"


def docs_of(spark, rows, extra=()):
    """Rows of (doc_id, text), with the columns of documents and ``extra`` ones that hold 7."""
    names = "".join(f", {c} int" for c in extra)
    return spark.createDataFrame([(i, t, None, "s", None, *[7] * len(extra)) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long{names}")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_one_id_with_two_texts_keeps_its_links_and_both_texts(spark):
    a, b, c = words(50, 1), words(50, 2), words(50, 3)
    docs = docs_of(spark, [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (4, c), (4, b), (5, ""), (5, ""), (None, a)])
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (2, 2), (3, 2), (4, 2), (4, 4), (4, 4), (5, 5), (5, 5)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in minhash.deduplicated(docs).collect())
    assert kept == sorted([(0, a), (1, a), (2, b), (4, c), (5, ""), (5, "")])


def test_deduplicated_keeps_all_columns(spark):
    a = words(30, 4)
    docs = docs_of(spark, [(1, a), (2, a), (2, a)], ("_again", "id", "row", "as", "n_shingles", "component_id"))
    got = minhash.deduplicated(docs).collect()
    assert [r.asDict() for r in got] == [docs.where("doc_id = 1").head().asDict()]


def test_sub_keys_follow_the_threshold():
    assert minhash.sub_keys(85, 3) == 8 and minhash.sub_keys(80, 3) == 11


@pytest.mark.parametrize("name", ["key", "words", "joined", "before"])
def test_scans_are_linear(name):
    rng = random.Random(1)
    key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1 << 20))
    text = {"key": "the bearer is " + key, "words": "token password secret " * 50_000, "joined": "token" * 200_000, "before": ("x" * 20 + " ") * 50_000 + "token"}[name]
    scanner = secrets.Scanner(secrets.identifier_dictionary())
    began = time.process_time()
    spans = scanner.spans(text)
    assert time.process_time() - began < 10
    assert name != "key" or (14, 3, 14 + len(key)) in spans


def plain_spans(text, scanner):
    """Novel spans by trying every run beside every sensitive word, with no memory of what was tried."""
    base = secrets._base(text)
    found = set()
    marks = [m.span() for m in secrets._SENSITIVE.finditer(text)]
    cuts = sorted({x for m in marks for x in m})
    for low, high in zip([0, *cuts], [*cuts, len(text)], strict=True):
        if (low, high) in marks:
            continue
        for c in secrets._CANDIDATE.finditer(text, low, high):
            beside = any(0 <= c.start() - e <= 64 or 0 <= s - c.end() <= 64 for s, e in marks)
            clear = not any(s < c.end() and c.start() < e for s, _, e in base)
            if beside and clear and scanner.novelty(text[max(0, c.start() - 512) : c.start()], c[0], text[c.end() : c.end() + 512].replace(c[0], "")) >= 0.8:
                found.add((c.start(), 3, c.end()))
    return sorted([*base, *found])


def test_novel_spans_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rng = random.Random(6)
    signs = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEF"
    planted = [(10_000 + i, words(40, i) + rng.choice([" bearer ", " the credential is ", " x "]) + "".join(rng.choices(signs, k=rng.choice([15, 16, 40]))) + rng.choice([" ", " private "]) + words(20, i)) for i in range(40)]
    docs = docs.unionByName(docs_of(spark, planted))
    names = secrets.corpus_identifiers(docs)
    assert names == sorted(names) and 0 < len(names) <= secrets.IDENTIFIERS and all(4 <= len(n) <= 15 for n in names)
    scanner = secrets.Scanner(secrets.identifier_dictionary(names))
    got = {r["doc_id"]: [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    wanted = {r["doc_id"]: plain_spans(r["text"] or "", scanner) for r in docs.collect()}
    assert got == wanted
    assert sum(any(k == 3 for _, k, _ in s) for s in wanted.values()) >= 5


def test_a_key_that_occurs_again_is_reported_each_time(spark):
    key = "q7Zx91LmPv02KsTtR8bWn4"
    got = secrets.scan(docs_of(spark, [(1, f"bearer {key} then bearer {key} end")]), names=[]).head()["spans"]
    assert [(s["start"], s["end"]) for s in got] == [(7, 29), (42, 64)]


def test_redact_keeps_clashing_columns(spark):
    docs = docs_of(spark, [(1, "token: abcdef0123456789abcd"), (2, None), (3, "")], ("spans", "kind"))
    got = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert got[1]["text"] == "[SECRET]" and got[1]["n_chars"] == 8 and got[1]["spans"] == 7 and got[2]["text"] is None and got[3]["text"] == ""
    assert secrets.redact(docs.where(F.lit(False))).count() == 0


def linked_rows(rows):
    """n_links and component of each row by brute force."""
    unit = [None if e is None or not len(e) else np.ldexp(np.array(e), -np.frexp(np.abs(e).max())[1]) for _, e in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = [[j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 for j in range(len(rows))] for i in range(len(rows))]
    group = list(range(len(rows)))
    for _ in rows:
        for i, line in enumerate(near):
            for j, hit in enumerate(line):
                if hit:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    return sorted((rows[i][0], sum(near[i]), least[group[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_of_every_length_and_size(spark, kind):
    rng = np.random.default_rng(3)
    base = {n: rng.normal(size=n) for n in (1, 2, 3, 5, 64)}
    rows = [(i, (base[n] + 0.05 * rng.normal(size=n)).astype("float32").astype(float).tolist()) for i, n in enumerate([2, 3, 5, 64, 64, 64, 3, 2, 5, 1, 1, 3])]
    rows += [(20, rows[0][1]), (20, rows[1][1]), (20, [-x for x in rows[0][1]]), (21, [2.0 * x for x in rows[3][1]])]
    if kind == "double":
        rows += [(30, [x * 1e200 for x in rows[3][1]]), (31, [x * 1e-200 for x in rows[3][1]])]
    df = spark.createDataFrame([(i, e, 7) for i, e in rows], f"vec_id long, embedding array<{kind}>, first int").withColumn("fine", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in quantisation.near_duplicates(df).collect())
    assert got == linked_rows(rows)


@pytest.mark.parametrize("few,dimensions", [(2, 64), (3, 256), (8, 256)])
def test_vectors_in_few_directions(spark, few, dimensions):
    """More vectors than lists hold, all within a few directions: every link of brute force is found."""
    rng = np.random.default_rng(few)
    x = rng.normal(size=(1500, few)) @ rng.normal(size=(few, dimensions))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    wanted = ((unit @ unit.T >= 0.95).sum(1) - 1).tolist()
    df = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in quantisation.near_duplicates(df, lists=40, block=200).collect()}
    assert got == dict(enumerate(wanted))


def test_long_words_are_merged_in_time_and_as_the_library_does(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.VOCABULARY)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (49, 60, 300, 5000)] + ["ab" * 3000, "a" * 4001, "\u4e2d\u6587" * 2000]
    with open(queries.VOCABULARY, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    merger = bpe.Merger(vocabulary)
    for text in texts:
        wanted = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.merge(text) == wanted and merger._long(text.encode()) == wanted
    began = time.process_time()
    assert len(merger._long("".join(rng.choices("etaoinshrdlu", k=1 << 20)).encode())) > 1 << 17
    assert time.process_time() - began < 10


def test_equal_lexicons_are_one_file(spark):
    docs = docs_of(spark, [(1, "some words and some words"), (1, "other"), (2, None)], ("ids", "word", "n"))
    first = sorted(map(tuple, bpe.encode(docs, queries.VOCABULARY).collect()), key=repr)
    assert sorted(map(tuple, bpe.round_trip(docs, queries.VOCABULARY).collect()), key=repr) == sorted(map(tuple, bpe.decode(bpe.encode(docs, queries.VOCABULARY), queries.VOCABULARY).collect()), key=repr)
    held = len(spark.sparkContext.listFiles)
    assert sorted(map(tuple, bpe.encode(docs, queries.VOCABULARY).collect()), key=repr) == first and len(spark.sparkContext.listFiles) == held


def test_mixed_documents_with_clashing_names_and_repeated_ids(spark):
    rows = [(i, words(30, i)) for i in range(40)] + [(1, words(30, 100)), (2, words(30, 2)), (None, words(20, 101)), (None, words(20, 102)), (None, None), (50, "")]
    docs = docs_of(spark, rows, ("_id", "_times", "_copy", "_source", "key", "row", "times", "size", "target"))
    got = mixing.mixed_documents(docs, block=4, shard_words=200).collect()
    assert all(r.asDict().keys() == set(docs.columns) and r["_id"] == r["_times"] == 7 for r in got)
    taken = {}
    for r in mixing._mixed(docs, block=4, shard_words=200).collect():
        k = (r["doc_id"], r["text_hash"])
        taken[k] = taken.get(k, 0) + (int(r["taken"] / r["size"] + 0.5) if r["size"] else 1)
    seen = {}
    by_hash = {(r["doc_id"], r["h"]): r["text"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    for r in got:
        seen[r["doc_id"], r["text"]] = seen.get((r["doc_id"], r["text"]), 0) + 1
    assert seen == {(i, by_hash[i, h]): n for (i, h), n in taken.items() if n}
    assert mixing.mixed_documents(docs.where(F.lit(False))).count() == 0


def test_many_shards_are_apportioned_by_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    docs = docs_of(spark, [(i, words(20 + i % 7, i)) for i in range(300)])
    got = mixing.mix_sources(docs, block=4, shard_words=100).collect()
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 4 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_filter_urls_keeps_clashing_columns_and_takes_a_table(spark):
    pages = spark.createDataFrame([(1, "http://a.bad.net/x", 7, 7, "h"), (2, "http://good.org/x", 7, 7, "h"), (3, None, 7, 7, "h"), (1, "http://a.bad.net/x", 7, 7, "h")], "page_id long, url string, _keys int, _rule int, host string")
    listed = spark.createDataFrame([("bad.net", 1), (None, 2), ("bad.net", 3)], "host string, n int")
    got = sorted(tuple(r[c] for c in ("page_id", "_keys", "_rule", "host", "verdict")) for r in url_filter.filter_urls(pages, queries.URL_RULES, listed).collect())
    assert got == [(1, 7, 7, "a.bad.net", "block")] * 2 + [(2, 7, 7, "good.org", "allow"), (3, 7, 7, "", "allow")]


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """documents with nulls in any column, empty and very long texts, repeated rows and ids, and a column of its own; labels of few."""
    folder = tmp_path_factory.mktemp("odd")
    long = words(20_000, 1)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, long), (6, long + " end"), (7, words(40, 2)), (7, words(40, 2)), (7, words(40, 3)), (8, words(40, 4)), (None, words(40, 5)), (None, None), (9, "x" * 5000)]
    docs = docs_of(spark, rows, ("score", "_id", "ids", "draw")).withColumn("source", F.when(F.col("doc_id") > 3, F.lit("s")))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 0, None), (7, 1, 0), (8, None, 1), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("rows", ["all", "none"])
def test_pipeline_with_odd_rows(spark, odd_folder, tmp_path, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    docs = docs if rows == "all" else docs.limit(0)
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, odd_folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == names or name == "bpe"
        assert rows == "all" or docs.count() == 0
    if rows == "all":
        assert docs.where("n_tokens <> size(ids)").count() == 0 and docs.count() > 0


def test_queries_that_share_ids_keep_every_row(spark, odd_folder):
    """Rows of one doc_id with different texts, and rows without one, are each scored, scanned, encoded and mixed."""
    n = spark.read.parquet(f"{odd_folder}/documents.parquet").count()
    for name in ("op1_compression_quality", "op5_mixing", "op6_host_rules", "op7_transducer_bpe", "op8_tensored_minhash", "op9_hidden_markov", "op10_secret_novelty", "op2_fm_substrings"):
        assert queries.QUERIES[name](spark, odd_folder).count() == n, name
