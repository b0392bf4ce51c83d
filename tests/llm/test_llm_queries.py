"""The queries on the smallest tables against DuckDB, libraries and plain versions."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

from clausewright.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in "documents embeddings pages benchmark labels conversations".split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def crc(ident, n):
    return zlib.crc32(str(ident).encode()) % n


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER)
    relation = duck.sql(sql.ORACLE_SQL[name])
    at = [relation.columns.index(c) for c in sorted(relation.columns)]
    assert sorted(got.columns) == sorted(relation.columns)
    assert sorted(repr([r[c] for c in sorted(got.columns)]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in relation.fetchall())


def test_quality_on_held_out_labels(spark, duck):
    got = {r["doc_id"]: r for r in queries.op1_compression_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], q) for i, q in labels if got[i]["held_out"]]
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == (crc(i, 5) == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_bpe_is_the_librarys(spark, texts):
    library = Tokenizer.from_file(queries.VOCABULARY)
    for r in queries.op7_transducer_bpe(spark, FOLDER).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language_model_base_and_gain(spark, texts):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), None] for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if crc(i, 7) != 2 for w in t)
    total, kinds = sum(counts.values()), len(counts)
    gain = held = 0.0
    for r in queries.op9_hidden_markov(spark, FOLDER).collect():
        t = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"], 7) == 2, len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        if r["held_out"]:
            gain, held = gain + r["score"] - base, held + len(t)
    assert gain / held > 0.1  # log10 a token


def test_secret_base_spans(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in queries.op10_secret_novelty(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        t = r["text"] or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in found) for i in range(3))
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
