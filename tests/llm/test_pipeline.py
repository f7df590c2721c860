"""The pipeline's stages, each on its own input, and run() as a whole against a brute-force version."""

import hashlib
import re
from collections import defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from millrace.llm import bpe, toxicity
from tests.llm.test_operators import brute_components, brute_decontam, brute_fp

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_exact_keeps(texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {min(g)[1] for g in groups.values()}


def brute_near_keeps(texts):
    fps = {i: brute_fp(t) for i, t in texts.items()}
    comp = brute_components(set(fps.values()))
    least = {}
    for i in sorted(fps):
        least.setdefault(comp[fps[i]], i)
    return set(least.values())


def brute_clean(texts, items):
    return {i for i, _, hit, _ in brute_decontam(texts.items(), items) if not hit}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_run_against_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in texts.items() if model.score(t) < 0.7}
    for keeps in (brute_exact_keeps, brute_near_keeps, lambda x: brute_clean(x, items)):
        left = {i: left[i] for i in keeps(left)}
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {}
    for i, t in left.items():
        ids = enc.encode_ordinary(t or "")
        want[i] = (len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert 0 < len(left) < len(texts)


def test_stages_keep_the_columns_and_take_awkward_rows(spark, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    rows = [(1, "a b c d", "en", "s", 7), (2, " a b c  d ", "en", "s", 9), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "word " * 30_000, "en", "s", 150_000), (6, "a b c d", "fr", "t", 7)]
    docs = spark.createDataFrame(rows, COLUMNS)
    want = {"toxicity": {1, 2, 3, 4, 5, 6}, "exact_dedup": {2, 3, 5}, "simhash_near_dedup": {1, 3, 5}, "decontamination": {1, 2, 3, 4, 5, 6}, "byte_bpe": {1, 2, 3, 4, 5, 6}}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert {r.doc_id for r in got.collect()} == want[name], name
        assert name == "byte_bpe" or got.columns == documents.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_judge_rows_and_not_ids(spark):
    """Null, repeated and shared ids: each row has a verdict of its own, and one row of a group of copies stays."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = max((r.text or "" for r in documents.collect()), key=model.score)
    leak = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 20)
    other = "one more text of quite other words about a garden in the rain"

    def run(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], COLUMNS)
        return sorted(r.source for r in stage(spark, docs, SF).collect())

    own = [(None, "plain words", "a"), (1, other, "c"), (1, other, "d")]
    assert run(corpus_pipeline.drop_contaminated, [*own, (1, leak, "e"), (None, leak, "f")]) == ["a", "c", "d"]
    # the stage is fitted on the rows that it is given, so the table's own rows come too
    table = [(r.doc_id, r.text, "") for r in documents.collect()]
    extra = [(None, "plain words", "a"), (-1, other, "c"), (-1, other, "d"), (-1, toxic, "e"), (None, toxic, "f")]
    assert [s for s in run(corpus_pipeline.drop_toxic, table + extra) if s] == ["a", "c", "d"]
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        assert run(stage, own)[0] == "a" and len(run(stage, own)) == 2
        assert run(stage, [(7, other, "x"), (7, leak, "y"), (5, leak, "z")]) == ["x", "z"]
        assert len(run(stage, [(None, other, "x"), (None, other, "y")])) == 1
        assert run(stage, [(None, other, "x"), (3, other, "y")]) == ["y"]
