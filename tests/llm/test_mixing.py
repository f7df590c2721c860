"""The mixing model: base scores, counts and mixed scores against brute force, its code, and texts it hasn't seen."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import mixing, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


def brute_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [None]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows):
    c = Counter(t for i, text in rows if not is_held(i) for t in brute_tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        tokens = brute_tokens(text)
        out.append((i, is_held(i), len(tokens), sum(c[t] > 0 for t in tokens), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), 5)))
    return Counter(out)


def as_rows(found):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op10_mixing(spark, SF).collect()
    assert as_rows(got) == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # the base gives each of all unseen words one share and does not spell them, so it is no distribution over texts
    seen = [r for r in got if r.n_known == r.n_tokens]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_held_out_texts_cost_less_than_the_base(spark):
    got = queries.op10_mixing(spark, "/root/testdata/sf0.1").where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.95 * got["sum(base_score)"]


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = ({r.doc_id: r.score for r in mixing.score(docs.repartition(n), block=size).collect()} for n, size in ((1, 1 << 18), (16, 1 << 10)))
    assert one.keys() == many.keys()
    assert all(abs(one[i] - many[i]) < 1e-5 * abs(one[i]) for i in one)


def test_a_text_that_occurs_twice_costs_less(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 3000, 300))
    rows = [(i, text()) for i in range(200)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    got = mixing.score(spark.createDataFrame(rows, DOCS)).collect()
    twice = [r.bits_per_byte for r in got if r.doc_id >= 1000 or r.doc_id < 20]
    once = [r.bits_per_byte for r in got if 20 <= r.doc_id < 200]
    # of a pair of which one is held out, the other cannot know it
    assert np.mean(np.array(twice) < min(once)) > 0.7


AWKWARD = [(1, "a b A c\n\td a b"), (2, None), (3, ""), (4, " \n"), (None, "a b"), (1, "a b A c\n\td a b"), (5, "é 字 " * 40_000), (6, "x" * 100_000), (7, "z\x00y \x1c")]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*x, 1, [2]) for x in AWKWARD], DOCS + ", row int, rare array<int>")
    for words in (1 << 18, 2):
        got = mixing.score(docs, words=words).collect()
        assert as_rows(got) == brute(AWKWARD)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert mixing.score(docs.limit(0)).count() == 0
    alone = mixing.score(docs.where("doc_id = 13").unionByName(spark.createDataFrame([(13, "p q", 1, [1])], docs.schema))).collect()
    assert [(r.n_tokens, r.n_known) for r in alone] in ([(3, 0)], [(3, 3)])


def book(words=("a", "bb", "ccc")):
    return mixing.Codebook([(w.encode(), 9 - i) for i, w in enumerate(words)] + [(b"", 3)], 2)


@pytest.mark.parametrize("weights", [[5, 1, 1, 9, 2], [1] * 256, [1, 1]])
def test_paths_form_a_prefix_code(weights):
    start, length, bits, nodes = mixing.huffman(weights)
    codes = ["".join(map(str, bits[s : s + n])) for s, n in zip(start, length, strict=True)]
    assert abs(sum(2.0 ** -len(c) for c in codes) - 1) < 1e-12
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert len({(int(nodes[s + k]), codes[i][:k]) for i, (s, n) in enumerate(zip(start, length, strict=True)) for k in range(n)}) == len(weights) - 1


def paths(b):
    """symbol: its bits as a string."""
    return {s: "".join(str(int(b.code[b.rank[s]]) >> (63 - d) & 1) for d in range(int(b.length[s]))) for s in range(len(b.length))}


def test_nodes_alone():
    b = book()
    own, weights = paths(b), [9, 8, 7, 3, 2]
    for s, path in own.items():
        rest = 0.0
        for d in reversed(range(len(path))):
            whole = sum(w for o, w in zip(own.values(), weights, strict=True) if o[:d] == path[:d])
            part = sum(w for o, w in zip(own.values(), weights, strict=True) if o[: d + 1] == path[: d + 1])
            rest += math.log2(part / whole)
            assert abs(1 / (1 + math.exp(-b.guess[b.start[s] + d])) - part / whole) < 1e-6
            assert abs(b.rest[b.start[s] + s + d] - rest) < 1e-9
        assert b.rest[b.start[s] + s + len(path)] == 0


@pytest.mark.parametrize("hot", [0, 6, 10_000])
def test_counts_and_scores_against_brute_force(spark, hot):
    """The counts that reach each bit, one by one, and the score that the weights make of them."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "e", "ff", "g", "rare" + str(i)], p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.08, 0.05, 0.02], size=40))) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    counts = Counter(t or "" for i, text in rows if not is_held(i) for t in brute_tokens(text))
    frequent = sorted(((w.encode(), n) for w, n in counts.items() if n > 1), key=lambda x: -x[1])
    b = mixing.Codebook(frequent, sum(n for n in counts.values() if n == 1), hot, 2)
    begin, own, reach = b.escape + 1, paths(b), 2
    symbols = {i: [b.index.get((t or "").encode(), b.escape) for t in brute_tokens(text)] for i, text in rows}
    seen = defaultdict(Counter)

    def orders(tokens, at):
        """The contexts of a token, and the depths at which each is followed."""
        one = tokens[at - 1] if at else begin
        two = tokens[at - 2] if at > 1 else begin
        short, both = b.hot[one] >= 0, b.hot[one] >= 0 and b.hot[two] >= 0
        return ((one,), 0, reach if short else 99), ((two, one), reach if both else 0, 99)

    for i, tokens in symbols.items():
        for at, s in enumerate(tokens):
            for context, *_ in orders(tokens, at):
                for d in range(0 if is_held(i) else len(own[s]) + 1):
                    seen[context][own[s][:d]] += 1
    table = mixing.blocks(docs.selectExpr("doc_id", "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2 as held_out", "cast(text as binary) as raw"), sent := spark.sparkContext.broadcast(b), 500)
    heads = spark.sparkContext.broadcast(mixing.after_frequent(table, sent))
    asking = mixing.asked(table, sent, 1)
    rows_ = asking.collect()
    weights, _ = mixing.Range(b, heads.value, [mixing.question(bytes(r.payload)) for r in rows_], [r.held for r in rows_]).learnt(1)
    assert (weights != mixing.first_weights()).any()
    scores = {r.doc_id: r.bits for r in mixing._score_rows(table, mixing.answered(asking, sent, heads, 1), sent, 1).collect()}
    for i, tokens in symbols.items():
        total, earned, less = 0.0, 0.0, 0 if is_held(i) else 1
        odds = mixing.TRUST
        for at, s in enumerate(tokens):
            path, known = own[s], []
            for context, low, high in orders(tokens, at):
                found = {}
                for d in range(low, min(high, len(path))):
                    whole, part = seen[context][path[:d]] - less, seen[context][path[: d + 1]] - less
                    if whole > 0:
                        found[d] = (part, whole - part)
                known.append(found)
            depth = max([0, *(d + 1 for x in known for d in x)])
            mixer = b.rest[b.start[s] + s + depth]
            for d in range(depth):
                values = [int(mixing.packed(np.array([x[d][0]]), np.array([x[d][1]]))[0]) if d in x else 0 for x in known]
                w = weights[mixing.CLASS[values[0]] * mixing.CLASSES + mixing.CLASS[values[1]]]
                g = np.array([b.guess[b.start[s] + d], *(mixing.GUESS[v] for v in values)])
                p = min(max(1 / (1 + math.exp(-float(w @ g))), mixing.LIMIT), 1 - mixing.LIMIT)
                mixer += math.log2(p)
            if at % mixing.STEP == 0:
                odds = min(max(mixing.TRUST + earned, mixing.TRUSTS[0]), mixing.TRUSTS[1])
            share, alone = 1 / (1 + math.exp(-odds)), b.rest[b.start[s] + s]
            total += math.log2(share * 2**mixer + (1 - share) * 2**alone)
            earned += (mixer - alone) * math.log(2)
        assert abs(scores[i] - total) < 0.01 * len(tokens) ** 0.5 + 0.002 * len(tokens), i  # costs are sent in parts of a bit


def test_spelling_is_a_distribution():
    """The probabilities of all bytes after a prefix add up to one."""
    rng = np.random.default_rng(3)
    model = mixing.Spelling(rng.integers(0, 1000, 256))
    model.counts = rng.integers(0, 4, len(model.counts))
    words, length = [b"ab" + bytes([x]) for x in range(256)], model.paths[1]
    bits = model.bits(words, np.zeros(256, bool))
    p = 1 / (1 + np.exp(-mixing.mixed_guess(model.weights, bits)))
    low, total = length[97] + length[98], 0.0
    for x in range(256):
        total += p[bits.owner == x][low : low + length[x]].prod()
    assert abs(total - 1) < 1e-4


def test_spelling_counts():
    """The slots of equal contexts and nodes are equal, those of others seldom, and a word's own count can be left out."""
    model = mixing.Spelling(np.ones(256, np.int64))
    places, owner = model.slots([b"abc", b"xbc", b"abc"])
    of = lambda w: [p[owner == w] for p in places]
    assert all(np.array_equal(a, b) for a, b in zip(of(0), of(2), strict=True))
    assert not any(np.array_equal(a, b) for a, b in zip(of(0), of(1), strict=True))
    for p in places:
        np.add.at(model.counts, p, 1)
    bits = model.bits([b"abc"], np.array([True])), model.bits([b"abc"], np.array([False]))
    assert (bits[0].guesses[2] < bits[1].guesses[2]).all()


def test_a_newton_step_lowers_the_cost():
    rng = np.random.default_rng(2)
    guesses = [rng.normal(1, 1, 5000).astype(np.float32) for _ in range(3)]
    bits = mixing.Bits(rng.integers(0, 4, 5000), guesses, np.zeros(5000, np.int64))
    weights = mixing.first_weights()
    better = mixing.improved(weights, mixing.slopes(weights, bits, np.ones(1)))
    loss = lambda w: np.log1p(np.exp(-mixing.mixed_guess(w, bits))).sum()
    assert loss(better) < loss(weights)


def test_recurring_letters_are_guessed_once(monkeypatch):
    """A word costs what its bits cost, and the work of a batch grows with its distinct letters in context, not with all."""
    rng = np.random.default_rng(4)
    words = list({bytes(rng.choice([97, 98, 195], size=n).astype(np.uint8)) for n in rng.integers(1, 12, 3000)})
    seen = np.arange(len(words)) % 3 > 0
    model = mixing.Spelling(np.ones(256, np.int64))
    model.counts = rng.integers(0, 4, len(model.counts))
    whole = model.bits(words, seen)
    expected, guessed = mixing.cost(model.weights, whole, len(words)), []
    monkeypatch.setattr(mixing, "cost", lambda weights, bits, n, cost=mixing.cost: guessed.append(len(bits.owner)) or cost(weights, bits, n))
    assert np.allclose(model.cost(words, seen), expected, rtol=1e-12)
    assert sum(guessed) < len(whole.owner) / 20


@pytest.mark.parametrize("size", [1, 30, 1 << 20])
def test_words_of_a_batch(size):
    """Words are split as bytes.split splits them, whatever the bytes and however many rows are taken at a time."""
    texts = ["a b A c\n\td a b", "", " \n", "É 字  x ", "z\x00y \x1c\x1d", "\x0b\x0cq\r\nA B c\x85", "x" * 100]
    batch = pa.record_batch({"raw": pa.array([t.encode() for t in texts], pa.binary())})
    got = []
    for rows, words, sizes in mixing.words_of(batch, size):
        assert len(rows) == len(sizes) and (size > 1 or len(rows) <= 1 + 2)  # empty texts join others
        ends = np.cumsum(sizes)
        got += [words.to_pylist()[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    assert got == [mixing_words(t.encode()) for t in texts]


def mixing_words(raw):
    return raw.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def test_columns_squeezed():
    rng = np.random.default_rng(5)
    for n in (0, 1, 300):
        columns = np.zeros(n, np.uint32), rng.integers(0, 1 << 19, n).astype(np.uint32), rng.integers(0, 1 << 32, n).astype(np.uint32) & np.uint32(0xFF00FF00), np.arange(n).astype(np.uint16)
        back = mixing.unsqueezed(mixing.squeezed(*columns), np.uint32, np.uint32, np.uint32, np.uint16)
        assert all(np.array_equal(a, b) for a, b in zip(columns, back, strict=True))


def test_by_range():
    rng = np.random.default_rng(6)
    for most in (5, 1 << 16, 1 << 20):
        to = rng.integers(0, most, 5000)
        assert np.array_equal(mixing.by_range(to), np.argsort(to, kind="stable"))


def test_ranges_asked_together(spark, monkeypatch):
    """With many ranges a block sends a message to a group of them, not to each, and gets the same answers."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(mixing, "RANGE", 1 << 12)
    apart = {r.doc_id: r.score for r in mixing.score(docs, block=1 << 14).collect()}
    rng = np.random.default_rng(1)
    b, keys = book(), np.unique(rng.integers(0, 4, 3000) << 2 * mixing.WORD_BITS | rng.integers(0, 4, 3000) << mixing.WORD_BITS | rng.integers(0, 5, 3000))
    one = [(to, *mixing.question(x)) for to, x in mixing.questions(b, keys, 40)]
    monkeypatch.setattr(mixing, "APART", 10)
    few = [(to, *mixing.question(x)) for to, x in mixing.questions(b, keys, 40)]
    assert mixing.grouped(40) == 4 and len(few) <= 10 < len(one)
    assert np.array_equal(np.concatenate([k for _, k, _ in one]), np.concatenate([k for _, k, _ in few]))
    assert [to // 4 for to, k, _ in one for _ in k] == [to for to, k, _ in few for _ in k]
    together = {r.doc_id: r.score for r in mixing.score(docs, block=1 << 14).collect()}
    assert apart.keys() == together.keys()
    assert all(abs(apart[i] - together[i]) < 1e-9 * abs(apart[i]) for i in apart)
