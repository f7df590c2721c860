"""Secret scans and URL lists against brute force, and on awkward rows."""

import hashlib
import re
import uuid
from collections import Counter
from datetime import date

from millrace.llm import queries, secrets, url_lists

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def brute_base(text):
    found = []
    for no, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        found += [(m.start(), no, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    spans = [f"{k}:{b}:{e}" for b, _, k, e in sorted(found)]
    return Counter(k for _, _, k, _ in found), spans


def ledger(spark, rules=secrets.RULES):
    return secrets.SecretLedger(spark, f"ledger_{uuid.uuid4().hex}", rules)


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_secrets(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        counts, spans = brute_base(text)
        assert [got[i][f"n_{k}"] for k in KINDS] == [counts[k] for k in KINDS]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert any(r.spans for r in got.values())


AWKWARD = [
    (1, "token=token=abcdefgh API_KEY: 'x' apikey=\"0123456789abcdef0123456789abcdef\" tail"),
    (2, None), (3, ""), (None, "secret = aaaaaaaa"), (1, "password=short token=longenough1"),
    (4, "é😀" * 50 + "passwd='ünï' SeCrEt:abcdefgh=" + "ſecret=abcdefgh toKen=abcdefgh"),
    (5, "AKIA" + "A" * 11 + " AKIAAKIA" + "B" * 12 + " xAKIA" + "C" * 40), (6, "token=abc secret=defghijk" * 3000),
    (7, "f" * 31 + "g" + "0" * 32 + "G" + "ab" * 40), (7, "f" * 31 + "g" + "0" * 32 + "G" + "ab" * 40), (8, "x" * 300_000),
]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*x, "b", 1, [1]) for x in AWKWARD], DOCS + ", blob string, rules int, found array<int>")
    own = ledger(spark, secrets.BASE_RULES)
    got = Counter((r.doc_id, tuple(f"{s.kind}:{s.start}:{s.end}" for s in r.found)) for r in own.add(docs).collect())
    assert got == Counter((i, tuple(brute_base(t)[1])) for i, t in AWKWARD)
    assert own.read().count() == len({t or "" for _, t in AWKWARD})
    assert ledger(spark).add(spark.createDataFrame([], DOCS)).count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    own = ledger(spark, secrets.BASE_RULES)
    own.add(spark.createDataFrame([(1, "secret=abcdefgh"), (2, "secret=abcdefgh"), (3, "-----BEGIN PRIVATE KEY-----")], DOCS)).collect()
    assert own.read().count() == 2
    again = own.add(spark.createDataFrame([(9, "secret=abcdefgh"), (8, "new")], DOCS))
    assert {(r.doc_id, len(r.found)) for r in again.collect()} == {(9, 1), (8, 0)}
    assert own.read().count() == 3
    newer = secrets.SecretLedger(spark, own.table, secrets.RULES)
    got = newer.add(spark.createDataFrame([(3, "-----BEGIN PRIVATE KEY-----"), (1, "secret=abcdefgh")], DOCS)).collect()
    assert {(r.doc_id, tuple(s.kind for s in r.found)) for r in got} == {(3, ("pem",)), (1, ("assign",))}
    added = {tuple(r.rules) for r in own.read().collect()} - {tuple(r.key for r in secrets.BASE_RULES)}
    assert added == {tuple(r.key for r in secrets.MORE_RULES)}


ENTRIES = "list string, kind string, pattern string, day date, seq int, action string"


def entries(spark, rows):
    return spark.createDataFrame([(a, b, c, d and date(2024, *d), s, x) for a, b, c, d, s, x in rows], ENTRIES)


def test_url_lists(spark):
    listed = entries(spark, [
        ("ads", "block", "Example.com", (1, 10), 1, "add"), ("ads", "block", "example.com", (2, 10), 1, "remove"), ("ads", "block", "example.com", (2, 10), 2, "add"),
        ("ads", "block", "example.com", (3, 1), 1, "remove"), ("ads", "block", "example.com", (3, 1), 1, "remove"), ("ok", "allow", "a.example.com", (1, 20), 1, "add"),
        ("paths", "block", "b.org/x/y", (1, 1), 1, "add"), ("bad", "block", None, (1, 1), 1, "add"), ("bad", "block", "b.org", None, 1, "add"), ("bad", "block", "b.org", (1, 1), 1, "oops"),
    ])
    rows = [
        (1, "http://www.example.com/", (1, 9)), (2, "http://u:p@WWW.Example.com:80/q?x#y", (1, 10)), (3, "https://example.com", (2, 29)), (4, "https://example.com", (3, 1)),
        (5, "http://a.example.com/", (1, 19)), (6, "http://a.example.com./", (2, 1)), (7, "http://notexample.com/", (1, 15)), (8, "http://b.org//x/y/z", (12, 31)), (9, "http://b.org/x/yy", (5, 5)),
        (10, None, (1, 15)), (11, "http://example.com/", None), (12, "example.com", (1, 15)), (13, "", (1, 15)), (14, "http://example.com/" + "a/" * 20_000, (1, 15)), (2, "http://u:p@WWW.Example.com:80/q?x#y", (1, 10)),
    ]
    captures = spark.createDataFrame([(i, u, d and date(2024, *d), "x", 7) for i, u, d in rows], "id int, url string, day date, pattern string, key int")
    got = Counter((r.id, r.n_active, ",".join(r.lists), r.pattern, r.blocked) for r in url_lists.judge(captures, listed).collect())
    ads = (1, "ads", "example.com", True)
    want = [(1, 0, "", None, False), (2, *ads), (2, *ads), (3, *ads), (4, 0, "", None, False), (5, *ads), (6, 2, "ads,ok", "a.example.com", False), (7, 0, "", None, False), (8, 1, "paths", "b.org/x/y", True)]
    assert got == Counter(want + [(i, 0, "", None, False) for i in (9, 10, 11, 12, 13)] + [(14, *ads)])
    assert url_lists.judge(captures, listed.limit(0)).where("n_active > 0").count() == 0
    assert url_lists.judge(captures.limit(0), listed).count() == 0


def test_paths_keep_their_case(spark):
    listed = entries(spark, [("paths", "block", "B.org/News", (1, 1), 1, "add"), ("more", "block", "b.org/a/B\nc", (1, 1), 1, "add")])
    rows = [(1, "http://b.org/News/1"), (2, "http://B.ORG/News"), (3, "http://b.org/news/1"), (4, "http://b.org/a/B\nc/d"), (5, "http://b.org/A/B\nc")]
    captures = spark.createDataFrame([(i, u, date(2024, 1, 5)) for i, u in rows], "id int, url string, day date")
    got = {r.id: (r.pattern, r.blocked) for r in url_lists.judge(captures, listed).collect()}
    news, more, none = ("b.org/News", True), ("b.org/a/B\nc", True), (None, False)
    assert got == {1: news, 2: news, 3: none, 4: more, 5: none}


def test_domains_of_one_label(spark):
    captures = spark.createDataFrame([(1, "http://a.example.com/", date(2024, 1, 5)), (2, "http://localhost/x", date(2024, 1, 5)), (3, "http://b.org/", date(2024, 1, 5))], "id int, url string, day date")
    got = lambda *patterns: {r.id for r in url_lists.judge(captures, entries(spark, [("l", "block", p, (1, 1), 1, "add") for p in patterns])).where("blocked").collect()}
    assert (got("com"), got("localhost"), got("b.org"), got("com", "b.org")) == ({1}, {2}, {3}, {1, 3})
