"""The operators against brute force on small inputs, and on awkward rows."""

import hashlib
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from millrace.llm import bpe, decontam, exact_dedup, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


AWKWARD = [(1, "a b c d e f g h i j k"), (2, None), (3, ""), (4, " \n\t"), (1, "a b c d e f g h i j k"), (None, "x"), (5, "A  b c\nd e f g h i j K"), (6, "word " * 30_000), (7, "é" * 5000)]


def awkward(spark):
    return spark.createDataFrame([(*x, "z", 1) for x in AWKWARD], DOCS + ", fp string, digest int")


# -- exact dedup


def brute_exact(rows):
    norm = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t, n in norm:
        groups[n].append((-len(t), i is None, i or 0))
    out = []
    for i, _, n in norm:
        _, none, keep = min(groups[n])
        keep = None if none else keep
        out.append((i, keep, len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup(spark):
    got = exact_dedup.DigestIndex(spark, f"d_{uuid.uuid4().hex}", 4).add(awkward(spark)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(AWKWARD)
    assert {r.doc_id for r in got if r.kept} >= {1, 4, 6, 7}
    assert not any(r.kept for r in got if r.doc_id in (2, 3))


def test_exact_dedup_is_incremental(spark):
    index = exact_dedup.DigestIndex(spark, f"d_{uuid.uuid4().hex}", 4)
    index.add(spark.createDataFrame([(5, "a b"), (6, "c")], DOCS)).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.add(spark.createDataFrame([(1, "ab"), (2, "d"), (3, "d")], DOCS)).collect()}
    assert got == {1: (5, 2, False), 2: (2, 2, True), 3: (2, 2, False)}
    assert index.read().count() == 3
    assert index.add(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_dedup_settles_all_batches(spark):
    rows = [(i, None if i % 9 == 0 else " " * (i % 5) + f"text {i % 7}") for i in range(60)] + [(None, "text 1"), (3, "text 3")]
    docs = spark.createDataFrame(rows, DOCS)
    index = exact_dedup.DigestIndex(spark, f"d_{uuid.uuid4().hex}", 4)
    for k in range(3):
        index.append(docs.where(f"coalesce(doc_id, 0) % 3 = {k}"))
    got = index.settled(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    assert index.read().count() == len({r.text_sha256 for r in got}) and spark.table(index.more).count() > 0
    copies = next(r.group_size for r in got if r.doc_id == 1)
    last = index.add(spark.createDataFrame([(99, "text 1"), (98, "new")], DOCS)).collect()
    assert {r.doc_id: (r.group_size, r.kept) for r in last} == {99: (copies + 1, False), 98: (1, True)}


# -- byte BPE


def test_bpe_matches_the_library_and_round_trips(spark, texts):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(path, pattern)
    for r in queries.op4_byte_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for text in ("", " " * 300_000, "ab  c\n\n d's　x  " * 20_000, "x" * 200_000, "　 a" * 50_000):
        assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)
    rows = bpe.encode(awkward(spark), path, pattern)
    assert rows.count() == len(AWKWARD)
    back = {r.doc_id: bytes(r.text_bytes).decode() for r in bpe.decode(rows, path, pattern).collect()}
    assert back == {i: t or "" for i, t in AWKWARD}
    assert bpe.encode(spark.createDataFrame([], DOCS), path, pattern).count() == 0


# -- decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def brute_decontam(rows, items):
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def as_rows(found):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect())


def test_decontamination(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_decontam(texts.items(), items)
    got = queries.op3_decontamination(spark, SF).collect()
    sha = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((i, n, h, len(x), sha(x), h > 0) for i, n, h, x in want.elements())
    assert any(r.contaminated for r in got)


def test_decontamination_of_awkward_rows_in_blocks_and_shards(spark):
    items = [(1, "A b c d e f g h i j"), (2, "x"), (10, None), (11, "!"), (12, "word word"), (1, "k"), (13, "b c d e f g h i j k l m")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = brute_decontam(AWKWARD, items)
    for shard_words, block_words in ((1 << 20, 1 << 20), (3, 1 << 20), (5, 4)):
        index = decontam.cut(decontam.build_index(awkward(spark), shard_words), "t")
        assert as_rows(decontam.search(index, bench, block_words=block_words)) == want
    index = decontam.build_index(awkward(spark))
    assert sum(n for (_, _, h, _), n in as_rows(decontam.search(index, bench.limit(0))).items() if h == 0) == len(AWKWARD)
    assert decontam.search(decontam.build_index(spark.createDataFrame([], DOCS)), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha x x x x x x x x x x beta gamma"), (3, "gamma alpha"), (4, "beta"), (5, "alpha beta gamma alpha")], DOCS)
    bench = spark.createDataFrame([(7, "gamma beta alpha")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.proximity(decontam.build_index(docs), bench, width=4).collect()}
    assert got == {(1, "7"), (5, "7")}


# -- SimHash


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_simhash(spark, texts):
    fps = {i: brute_fp(t) for i, t in texts.items()}
    comp = brute_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    got = queries.op6_simhash(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", least[comp[f]]) for i, f in fps.items()}
    assert len(got) == len(texts)


@pytest.mark.parametrize("n", [10, 10**5, 10**9, 10**13])
def test_masks_meet_all_near_pairs(n):
    from itertools import combinations

    masks = simhash.ball_masks(n, 3, 256)
    rng = np.random.default_rng(6)
    flips = [sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(3000)] + [sum(1 << b for b in c) for c in combinations(range(0, 64, 8), 3)]
    assert all(any(f & m == 0 for m in masks) for f in flips)
    assert min(m.bit_count() for m in masks) >= min(28, np.log2(n / 256))


@pytest.mark.parametrize(("leaf", "ball"), [(4, 256), (100_000, 256), (64, 2), (64, 100_000)])
def test_links_and_components_of_crowded_fingerprints(spark, leaf, ball):
    rng = np.random.default_rng(5)
    near = [0x123456789ABCDEF0 ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(700)]
    chain, f = [], 0xFFFF0000FFFF0000
    for b in range(0, 60, 3):
        f ^= 7 << b
        chain.append(f)
    fps = {*near, *chain, *(int(x) for x in rng.integers(0, 1 << 63, 300)), 0, 1 << 63}
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 3, leaf, ball=ball)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()]
    assert len(pairs) < 40 * len(fps)
    comp = brute_components(fps)
    root = {(r.node % (1 << 64)): r.root % (1 << 64) for r in simhash.components(found).collect()}
    same = defaultdict(set)
    for x in fps:
        same[root.get(x, x)].add(x)
    want = defaultdict(set)
    for x in fps:
        want[comp[x]].add(x)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_awkward_rows(spark):
    got = simhash.near_dups(awkward(spark)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{brute_fp(t):016x}") for i, t in AWKWARD)
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert simhash.near_dups(spark.createDataFrame([], DOCS)).count() == 0
    last = [((1 << 63) - 1, "a b c"), (None, "a b c"), (None, "d e")]
    assert sorted(r.component_id or 0 for r in simhash.near_dups(spark.createDataFrame(last, DOCS)).collect()) == [0, (1 << 63) - 1, (1 << 63) - 1]
    named = spark.createDataFrame([("b", "a b c"), ("a", "a b c")], "doc_id string, text string")
    assert {r.component_id for r in simhash.near_dups(named).collect()} == {"a"}


def test_trees_prune_and_find_all_pairs():
    rng = np.random.default_rng(7)
    points = np.unique(rng.integers(0, 1 << 63, 40).astype(np.uint64)[rng.integers(0, 40, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)))
    tree = simhash.VantageTree(points)
    assert sum(len(n) == 4 for n in tree.nodes) > 5
    got = {tuple(x) for a, b in tree.pairs(3) for x in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for j in range(len(points)) for i in range(j) if (int(points[i]) ^ int(points[j])).bit_count() <= 3}


# -- toxicity


def test_toxicity_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    caught = [r.predicted for r in got if labels[r.doc_id] == 1]
    wrong = [r.predicted for r in got if labels[r.doc_id] == 0]
    assert sum(caught) / len(caught) > 0.9
    assert sum(wrong) / len(wrong) < 0.01
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 8)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.fit(docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(docs.limit(0), nothing).count() == 0


def rows_of(x):
    return toxicity.Rows(np.nonzero(x)[1], x.sum(axis=1).astype(int))


def test_nnpu_recovers_a_separator():
    rng = np.random.default_rng(1)
    pos = rng.random((300, 6)) < [0.9, 0.9, 0.1, 0.5, 0.5, 0.5]
    neg = rng.random((900, 6)) < [0.1, 0.1, 0.9, 0.5, 0.5, 0.5]
    unl = np.concatenate([neg, rng.random((100, 6)) < [0.9, 0.9, 0.1, 0.5, 0.5, 0.5]])
    w = toxicity.fit_nnpu(rows_of(pos), rows_of(unl), 6, 0.1)
    assert (pos @ w[:-1] + w[-1] > 0).mean() > 0.8 and (neg @ w[:-1] + w[-1] > 0).mean() < 0.1
    assert w[2] < 0 < w[0]  # features speak against toxicity too


def test_nnpu_against_a_plain_loop():
    """Risks and weights by dense matrices and one row at a time."""
    rng = np.random.default_rng(2)
    pos, unl, prior, decay = rng.random((12, 4)) < 0.6, rng.random((30, 4)) < 0.4, 0.2, 1e-3
    w, m, v = np.append(np.zeros(4), np.log(prior / (1 - prior))), np.zeros(5), np.zeros(5)
    for step in range(1, 41):
        sums = {"+": np.zeros(5), "-pos": np.zeros(5), "-unl": np.zeros(5)}
        loss = {"pos": 0.0, "unl": 0.0}
        for name, x in (("pos", pos), ("unl", unl)):
            for r in x:
                p = 1 / (1 + np.exp(-(r @ w[:-1] + w[-1])))
                sums[f"-{name}"] += p * np.append(r, 1) / len(x)
                loss[name] -= np.log(1 - p) / len(x)
                if name == "pos":
                    sums["+"] += (p - 1) * np.append(r, 1) / len(x)
        rest = sums["-unl"] - prior * sums["-pos"]
        g = prior * sums["+"] + rest if loss["unl"] - prior * loss["pos"] >= 0 else -rest
        g += decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(w, toxicity.fit_nnpu(rows_of(pos), rows_of(unl), 4, prior, steps=40, decay=decay))


def brute_features(text):
    w = [x.encode() for x in words(text)]
    own = Counter(w)
    for n in (4, 5):
        own.update(x[:n] + b"*" for x in w if len(x) > n)
    return set(own) | {f + b"+" for f, c in own.items() if c >= 2 and c >= len(w) / 200}


def test_toxicity_scores_against_brute_force(spark, texts):
    """The fitted weights, applied to features made another way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in toxicity.score(docs, model).collect():
        z = model.bias + sum(model.weights.get(f, 0.0) for f in brute_features(texts[r.doc_id]))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_digest_index_has_a_bucket_for_each_task(spark):
    index = exact_dedup.DigestIndex(spark, f"d_{uuid.uuid4().hex}")
    assert index.buckets >= 211  # sessions that deal keys to 211 tasks at least
    index.append(spark.range(3000).selectExpr("id AS doc_id", "string(id) AS text"))
    files = spark.table(index.table).inputFiles()
    assert index.read().count() == 3000 and len(files) == index.buckets and not spark.table(index.more).inputFiles()
