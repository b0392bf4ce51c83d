"""Token files against the tokenizers library, and their planes and indexes by round trips."""

import io
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from clausewright.llm import library, planes, queries

FOLDER = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t ", "a", "Hello, World!", "It's the DOG's... isn't it?", "x" * 5000, "1,234.5 99% #tag @me", "<|endoftext|>", "a<|endoftext|>b, <|startoftext|>.", "<|ENDOFTEXT|> <|endoftext|", "a b c　d\u0085e",
    "\x1c\x1d one\x1ftwo \x00 \x01", "école ÉCOLE Ångström", "İstanbul ΣΑΣ ΟΔΟΣ ς", "你好。世界，再见", "שׁלום ﬁne ﬀ", "🙂👍🏽 ok🙂.", "á.", "́. x́,y", "wörd. Wörd, WÖRD; wörd:", "a.b.c... ...", "'s 't s' ''", "ⅷ ² ½ ٣.", "퟿ ￿", "naïve, Naïve?!", "a,,,b,", "  lead and trail  ",
]


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(queries.VOCABULARY)
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def source():
    with open(queries.VOCABULARY, encoding="utf-8") as f:
        return f.read()


def expected(rows, tokenizer, end=2):
    """(doc_id, start, n_tokens, crc32) of each row, one after another."""
    found, start = [], 0
    for i, ids in sorted(((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        found.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


@pytest.mark.parametrize("line", [1, 3, 500])
def test_words_have_the_librarys_ids(tokenizer, source, monkeypatch, line):
    monkeypatch.setattr(library, "LINE", line)
    encoder = library.LibraryEncoder(source)
    assert encoder.by_words and encoder.width == 2
    texts = [*ODD, *[f"{a} {b}{c}" for a in ODD if a for b in ("Word", "é", "9", "́") for c in (".", "", "!?")]]
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    to = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(to.tolist(), counts.tolist(), strict=True)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_file_that_keeps_white_space_goes_to_the_library_whole(source):
    file = json.loads(source)
    file["pre_tokenizer"]["pretokenizers"][0]["behavior"] = "Isolated"
    other = json.dumps(file)
    encoder, plain = library.LibraryEncoder(other), Tokenizer.from_str(other)
    assert not encoder.by_words
    ids, counts = encoder.encode(pa.array(["a b  c", None, "d"]))
    assert counts.tolist()[1] == 0 and ids[: counts[0]].tolist() == plain.encode("a b  c", add_special_tokens=False).ids


def test_cut_at_white_space_only():
    text = "ab cd\n" * 50 + "x" * 400 + " end"
    parts = library.cut(text, 20)
    assert "".join(parts) == text and len(parts) > 10 and all(p[0] in " \n" for p in parts[1:])
    assert library.cut("x" * 100, 20) == ["x" * 100] and library.cut("", 20) == [""]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("kind", ["<u2", "<u4"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_turn_back(bits, kind, n):
    ids = np.random.default_rng(n).integers(0, np.iinfo(kind).max, n, kind, True)
    rows = planes.to_planes(ids, bits)
    assert len(rows) == ids.dtype.itemsize * (8 if bits else 1)
    assert planes.from_planes(rows, n, ids.dtype.itemsize, bits).tolist() == ids.tolist()


class _Stream(io.BytesIO):
    def close(self):
        self.whole = self.getvalue()


class _File(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]

    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("bits", [False, True])
def test_shard_gives_every_document_from_any_block(bits):
    rng = np.random.default_rng(3)
    docs = [(None if k == 0 else k, rng.integers(0, 49_408, n).astype("<u2")) for k, n in enumerate([5, 0, 8, 16, 1, 100, 7, 0, 3, 4, 0])]
    stream = _Stream()
    writer = planes.ShardWriter(stream, 2, 8, bits)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    shard = planes.Shard(_File(stream.whole))
    n = len(shard.chunks)
    for step in (1, 3, n):
        got = [(i, s, np.concatenate([np.zeros(0, "<u2"), *p]).tolist()) for c in range(0, n, step) for i, s, p in shard.documents(c, c + step)]
        assert [(i, ids) for i, _, ids in got] == [(i, ids.tolist()) for i, ids in docs]
        assert [s for _, s, _ in got] == np.cumsum([0, *(len(ids) for _, ids in docs)])[:-1].tolist()
    with pytest.raises(ValueError):
        planes.Shard(_File(stream.whole[:-3]))


def test_query_is_the_librarys(spark, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_token_planes(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == sorted(expected(rows, tokenizer))


@pytest.mark.parametrize("bits", [False, True])
def test_odd_rows_over_many_shards(spark, tokenizer, bits):
    rows = [(i * 7 - 50, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "same id"), (3, "same id"), (3, "another"), (2**62, "far")]
    docs = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "doc_id long, text string, part int, path string, ids binary").repartition(5)
    manifest = planes.write(docs, queries.VOCABULARY, end=2, shards=4, block=16, bits=bits)
    assert 1 < manifest.count() <= 4
    assert sorted(map(repr, (tuple(r) for r in planes.read(manifest).collect()))) == sorted(map(repr, expected(rows, tokenizer)))


def test_no_rows_and_no_end(spark, tokenizer):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert planes.read(planes.write(docs, queries.VOCABULARY, end=2)).count() == 0
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in planes.read(planes.write(empty, queries.VOCABULARY)).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]


def test_long_texts_are_cut_and_joined(spark, tokenizer):
    text = "Some words, and numbers 12.5; " * 400
    rows = [(1, text), (2, "x" * 3000), (3, "short"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with open(queries.VOCABULARY, encoding="utf-8") as f:
        got = planes.token_ids(docs, f.read(), 2, [], longest=100).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        assert (r["doc_id"], np.frombuffer(r["ids"], "<u2").tolist()) == (i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
