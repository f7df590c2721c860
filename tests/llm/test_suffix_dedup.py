"""Suffix-array dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from millrace.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def brute(rows, length):
    places = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in texts:
        for b in range(len(raw) - length + 1):
            places[raw[b : b + length]] += 1
    out = []
    for i, raw in texts:
        gone = np.zeros(len(raw) + 1, bool)
        for b in range(len(raw) - length + 1):
            if places[raw[b : b + length]] > 1:
                gone[b : b + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((i, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def as_rows(found):
    return Counter((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), r.kept_sha256) for r in found.collect())


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in queries.op8_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute(rows, 400)
    assert any(k[2] for k in got)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.OP8_SQL)
    names = [d[0] for d in want.description]
    assert Counter(want.fetchall()) == Counter(tuple(r) for r in queries.op8_suffix_dedup(spark, SF).select(*names).collect())


@pytest.mark.parametrize("batches", [(1,), (1, 1, 1), (4, 1)])
def test_overlaps_shifts_and_awkward_rows(spark, batches):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdé"), n))
    shared = word(90)
    rows = [(1, word(50) + shared + word(30)), (2, shared[10:80] + word(20)), (3, word(9) + shared[30:] + shared[:60]), (4, None), (5, ""), (6, "x" * 300), (7, "short"), (None, "short"), (8, word(500)), (8, "ab" * 100)]
    rows += [(20 + i, word(15) + shared[i : i + 45] + word(15)) for i in range(0, 40, 3)] + [(9, rows[7][1]), (10, rows[0][1])]
    docs = spark.createDataFrame([(*x, "d", 1) for x in rows], DOCS + ", digest string, first int")
    got = suffix_dedup.remove_repeats(docs, 40, 10, 5, batches=batches)
    assert as_rows(got) == brute(rows, 40)
    for r in got.where("doc_id = 1").collect():
        raw = rows[0][1].encode()
        assert bytes(r.kept) == b"".join(bytes([x]) for at, x in enumerate(raw) if not any(s.begin <= at < s.end for s in r.spans))


def test_passages_under_the_length_are_told(spark):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = word(390)
    rows = [(1, word(900) + passage + word(900)), (2, word(700) + passage + word(800)), (3, word(2000)), (4, word(120)), (5, None)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows + [(6, rows[3][1])], DOCS)).collect()}
    assert not any(r.spans for r in got.values())
    assert {i for i, r in got.items() if r.n_shared} == {1, 2, 4, 6}


def test_keys_stand_in_the_order_of_their_first_bytes():
    raw = bytes(np.random.default_rng(7).integers(0, 256, 5000).astype(np.uint8))
    h, _, seed, _, _ = suffix_dedup.entries_of(raw)
    heads = [raw[seed[i] : seed[i] + 3] for i in np.argsort(h.view(np.int64))]
    assert heads == sorted(heads) and len(heads) > 20


def test_levels_stand_and_merge_by_size(spark):
    rows = spark.range(1600).selectExpr("id * 7919 as h", "unhex(md5(cast(cast(id as string) as binary))) as digest", "id as w", "0 as seed", "0 as first", "0 as last")
    index = suffix_dedup.SuffixLevels(spark)
    for low, high, sizes in ((0, 1000, [1000]), (1000, 1400, [1000, 400]), (1400, 1500, [1000, 400, 100]), (1500, 1600, [1000, 400, 200]), (0, 1, [1000, 400, 200, 1])):
        index.add(rows.where(f"w >= {low} and w < {high}"))
        assert [n for n, _ in index.levels] == sizes
    assert [r.h for r in index.entries().collect()] == [0, 0]


def test_no_rows(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a")], DOCS)).count() == 1


def test_texts_longer_than_a_chunk(spark):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefgh"), 150_000))
    rows = [(1, long), (2, "zz" + long[65_400:66_200] + "yy"), (3, long[140_000:])]
    got = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: [(65_400, 66_200), (140_000, 150_000)], 2: [(2, 802)], 3: [(0, 10_000)]}
