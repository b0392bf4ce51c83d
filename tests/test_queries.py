"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from clausewright import queries as catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def rows(data, columns):
    return sorted(repr([r[c] for c in columns]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    relation = duck.sql(catalog.ORACLE_SQL[name])
    wanted = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    assert sorted(got.columns) == sorted(relation.columns)
    assert rows((r.asDict() for r in got.collect()), sorted(got.columns)) == rows(wanted, sorted(got.columns))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_links_are_walked(spark):
    from clausewright.sources.pages import walk

    got = {r["page_id"]: r["links"] for r in catalog.QUERIES["page_links"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").limit(20).collect():
        assert got[r["page_id"]] == walk(r["html"]).links >= r["html"].count('<li><a href="')


def _gaps(text):
    """What every other line leaves, by plain searching."""
    at, gaps = 0, []
    for part in [x.strip() for x in text.split("\n") if x.strip()][::2]:
        found = text.find(part, at)
        if found >= 0:
            gaps.append(text[at:found].strip())
            at = found + len(part)
    return "|".join(g for g in [*gaps, text[at:].strip()] if g)


def test_whole_tables_against_plain_versions(spark, tmp_path):
    """Also long texts, repeated and nested lines, and titles with entities, which the queries with SQL leave out."""
    import html

    long = "\n".join(f"line {i}. Of a long text. " for i in range(400))
    texts = [(1, long), (2, "a\nb\na\nb\nb a\na"), (3, "x y\ny\nx\nx y z\ny"), (4, ""), (5, None), (6, "one\n\n two. three\nfour"), (7, "b\nab\nabc\nb")]
    titles = ["A &amp; B", "plain", "&lt;x&gt; &quot;", "AT&amp;T &#8211; news"]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(i, f"<html><head><title>{t}</title></head><body></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["gaps"] for r in run("coverage_gaps_all")} == {i: None if t is None else _gaps(t) for i, t in texts}
    wanted = [(i, k, s) for i, t in texts for k, s in enumerate(x for x in (p.strip() for p in (t or "").replace(". ", ".\1").split("\1")) if x)]
    assert sorted(tuple(r[c] for c in ("doc_id", "pos", "sentence")) for r in run("sentence_units_all")) == sorted((i, k, s) for i, k, s in wanted)
    assert {r["page_id"]: r["title"] for r in run("page_title_all")} == {i: html.unescape(t) for i, t in enumerate(titles)}


def test_whole_tables_hold_every_row(spark, duck):
    n = {t: duck.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("documents", "pages")}
    gaps = {r["doc_id"]: r["gaps"] for r in catalog.QUERIES["coverage_gaps_all"](spark, FOLDER).collect()}
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert gaps == {i: None if t is None else _gaps(t) for i, t in texts.items()}
    assert catalog.QUERIES["page_title_all"](spark, FOLDER).where("title IS NOT NULL").count() == n["pages"]
    assert catalog.QUERIES["sentence_units_all"](spark, FOLDER).select("doc_id").distinct().count() == duck.sql("SELECT count(*) FROM documents WHERE trim(text, ' ' || chr(10)) <> ''").fetchall()[0][0]
