"""The Merkle manifest against a plain version of the contract."""

import hashlib
import random
import zlib

import pytest

from clausewright.llm import merkle, queries

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(hashes):
    """All levels of a tree, from the leaves to the single root."""
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def steps_of(levels, at):
    for level in levels[:-1]:
        low = at - at % 3
        run = level[low : low + 3]
        yield at - low, [*run[: at - low], *run[at - low + 1 :]]
        at //= 3


def plain(rows):
    """The rows of the contract for rows of (doc_id, source, lang, n_chars, text)."""
    hashed = []
    for r in rows:
        doc_id, text = r[0], r[4]
        change = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        cut = text.replace("\n", "") if change and text is not None else text
        hashed.append((r[1], doc_id, sha("".join(map(framed, r))), sha("".join(map(framed, (*r[:4], cut))))))
    hashed.sort(key=lambda h: (h[0] is not None, (h[0] or "").encode(), h[1] is not None, h[1] or 0, h[2]))
    sources = sorted({h[0] for h in hashed}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([h[2] for h in hashed if h[0] == s]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, doc_id, leaf, cut) in enumerate(h for h in hashed if h[0] == s):
            steps = [*steps_of(trees[s], at), *steps_of(top, k)]
            folded = cut
            for place, others in steps:
                folded = sha("".join([*others[:place], folded, *others[place:]]))
            root = top[-1][0]
            out.append((doc_id, leaf, trees[s][-1][0], root, sha("".join(x for _, o in steps for x in o)), folded, folded == root))
    return sorted(out, key=repr)


def proved(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, grp string, idx int, leaf boolean")


def test_query_is_the_plain_version(spark):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.op13_merkle_manifest(spark, FOLDER)
    assert proved(got) == plain(rows)
    assert {v for *_, v in plain(rows)} == {True, False}


@pytest.mark.parametrize("parts", [1, 7])
def test_groups_over_parts_and_odd_rows(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, "", "=", "é", "zz"]), rng.choice(["en", None]), rng.choice([1, None]), rng.choice(["one\ntwo", "one", "", None, "é\n\n"])) for i in range(1500)]
    rows += [(None, "a", None, None, "no\nid"), (None, None, None, None, None), *[(7, "a", "en", 1, "again\n")] * 3, (7, "a", "en", 1, "other\n"), (-5, "alone", "en", 1, "x"), *[(10**6 + i, "host", None, None, f"{i}\n") for i in range(9)]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert proved(merkle.prove(docs_of(spark, rows))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_one_source(spark, n):
    rows = [(i * 3, "s", "en", i, f"text\n{i}") for i in range(n)]
    assert proved(merkle.prove(docs_of(spark, rows))) == plain(rows)


def test_many_sources_and_none(spark):
    rows = [(i, f"s{i % 800}", None, None, "x\n" * (i % 3)) for i in range(900)]
    assert proved(merkle.prove(docs_of(spark, rows))) == plain(rows)
    assert merkle.prove(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_stacks_over_any_cuts_leave_what_merges_to_the_root(seed):
    """Stretches of any lengths: closed nodes and merged open ones are those of the whole tree."""
    rng = random.Random(seed)
    total = rng.choice([1, 2, 3, 8, 27, 100, 730])
    leaves = [bytes.fromhex(sha(str(i))) for i in range(total)]
    whole = levels_of([d.hex() for d in leaves])
    edges = sorted({0, total, *(rng.randrange(total + 1) for _ in range(rng.randrange(6)))})
    pool, closed = {}, {}
    for a, b in zip(edges, edges[1:], strict=False):
        stack = merkle.Mountains()
        for i in range(a, b):
            stack.push(0, i, leaves[i])
        stack.close(total, b == total)
        for level, idx, digest, is_open in stack.nodes:
            assert whole[level][idx] == digest.hex()
            (pool if is_open else closed)[level, idx] = digest
    for level in range(merkle.height(total)):
        runs = {}
        for (x, idx), digest in sorted(pool.items()):
            if x == level:
                runs.setdefault(idx // 3, []).append(digest)
        for idx, run in runs.items():
            up = merkle.joined(run)
            assert whole[level + 1][idx] == up.hex()
            (pool if level + 1 < merkle.height(total) else closed)[level + 1, idx] = up
    assert closed[merkle.height(total), 0].hex() == whole[-1][0]
    assert {k for k in (*pool, *closed) if k[0] >= merkle.BLOCK} == {(level, i) for level in range(merkle.BLOCK, len(whole)) for i in range(len(whole[level]))} | {k for k in closed if k[0] >= merkle.BLOCK}


def test_tall_trees_take_no_more_steps_than_low_ones(spark):
    """A tree of three layers of blocks over many parts: right, and by a plan and jobs that do not grow with each level."""
    rows = [(i, "tall" if i % 50 else "low", None, None, f"{i}\n") for i in range(62000)]
    docs = docs_of(spark, rows).repartition(7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.sparkContext.setJobGroup("tall tree", "")
        got = merkle.prove(docs)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("tall tree"))
        exchanges = got._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        assert proved(got) == plain(rows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert merkle.height(len(rows)) > 2 * merkle.BLOCK
    assert exchanges <= 20, exchanges
    assert jobs <= 30, jobs
