"""Cases that gave wrong results or held too much: ids beside null ones, runs of one sign, words without blanks."""

import random
import string

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausewright.llm import bpe, queries, secrets, substring
from clausewright.llm._shared import most_frequent


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("gap", [1, 1000])
def test_great_ids_beside_a_null_one_lose_one_copy(spark, gap):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(2**60 + 1, words), (2**60 + 1 + gap, words), (None, "other words"), (None, words)]
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs_of(spark, rows).coalesce(1)).where("doc_id IS NOT NULL").collect()}
    assert got == {2**60 + 1: 0, 2**60 + 1 + gap: 30}


PLAIN = [
    "| token | value |\n|------------------------|------|", "Password\n=======================\nabc", "private key: ____________________________ (sign here)", "secret --------------------------------", "bearer ++++++++++++++++++++++++",
    "token aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "secret abababababababababababababab", "the secret ================ of it", "access key 0000000000000000000000", "credential =-=-=-=-=-=-=-=-=-=-=-=-=-",
]


@pytest.mark.parametrize("text", PLAIN)
def test_runs_of_few_signs_are_no_secrets(text):
    scanner = secrets.Scanner(secrets.identifier_dictionary())
    for filler in ("", " ".join(["some words around it"] * 30)):
        assert [s for s in scanner.spans(f"{filler} {text} {filler}") if s[1] == 3] == []


@pytest.mark.parametrize("signs", [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.digits + "ABCDEF", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits])
def test_random_keys_are_still_found(signs):
    rng = random.Random(5)
    scanner = secrets.Scanner(secrets.identifier_dictionary())
    keys = ["".join(rng.choices(signs, k=n)) for n in (16, 20, 32, 64, 256) for _ in range(20)]
    found = sum(any(k in (1, 2, 3) for _, k, _ in scanner.spans(f"and then the secret is {key} as they said")) for key in keys)
    assert found >= 0.98 * len(keys)


def test_remembered_words_are_bounded_by_their_bytes():
    with open(queries.VOCABULARY, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    encoder = bpe.Encoder(bpe.Splitter(vocabulary.special), bpe.Merger(vocabulary), bpe.Lexicon.build([]))
    library = Tokenizer.from_file(queries.VOCABULARY)
    library.no_truncation()
    rng = random.Random(7)
    most = 0
    bound, bpe.MEMORY = bpe.MEMORY, 1 << 20
    try:
        for _ in range(20):
            texts = ["".join(rng.choices("abcdefghij", k=1000)) for _ in range(100)]
            rows = encoder.encode(texts)
            most = max(most, sum(map(len, encoder.known)) + sum(map(len, encoder.known.values())))
        assert most < (1 << 20) + 2 * 100 * 5000 and encoder.held < (2 << 20)
        assert [int.from_bytes(rows[-1][i : i + 4], "little") for i in range(0, len(rows[-1]), 4)] == library.encode(texts[-1], add_special_tokens=False).ids
    finally:
        bpe.MEMORY = bound
    encoder.forget()
    assert encoder.held == 0 and not encoder.known


def test_any_sample_gives_the_same_ids(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, queries.VOCABULARY).collect()}
    monkeypatch.setattr(bpe, "SAMPLE", 20)
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(docs, queries.VOCABULARY).collect()} == want


def test_identifiers_are_counted_over_all_documents(spark):
    rare = F.concat(F.lit("pair_"), F.translate((F.col("id") % 50).cast("string"), "0123456789", "abcdefghij"))
    docs = spark.range(20_000).select(F.when(F.col("id") % 10_000 < 50, rare).otherwise(F.sha1(F.col("id").cast("string"))).alias("text"))
    letters = [str(i).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(50)]
    assert secrets.corpus_identifiers(docs) == sorted(f"pair_{x}" for x in letters)


def test_identifiers_are_the_most_frequent_ones_exactly(spark):
    """Counts that lie close together are told apart, and of equal ones as many are taken as there is room for."""
    counts = spark.range(900).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.when(F.col("id") < 300, 101).when(F.col("id") < 600, 100).otherwise(2).cast("long").alias("n"))
    for size, wanted in ((300, {101: 300}), (400, {101: 300, 100: 100}), (750, {101: 300, 100: 300, 2: 150})):
        got = most_frequent(counts, size).groupBy("n").count().collect()
        assert {r["n"]: r["count"] for r in got} == wanted
    words = [{r["word"] for r in most_frequent(counts.repartition(k), 750).collect()} for k in (1, 7)]
    assert words[0] == words[1]
