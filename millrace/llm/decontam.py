"""Benchmark decontamination on a distributed positional inverted index.

Training documents are dealt into shards of a bounded number of words. A shard
is one row of the index: its documents, its distinct terms and, per term, the
ascending positions at which it stands. Positions count words within the shard
with one empty place after each document, so an offset-adjusted intersection
never crosses documents. A search broadcasts a block of the test windows, of
checked size, to all shards; more windows than a block holds are searched block
by block. In a shard the lists of a window's terms are intersected from the
rarest term on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD_BYTES, cut, word_tokens

WINDOW = 10
INDEX_SCHEMA = "shard string, doc_ids array<long>, n_words array<int>, terms array<binary>, ends binary, positions binary"


def build_index(docs: DataFrame, shard_words: int = 1 << 20) -> DataFrame:
    """Index rows of ``docs`` (doc_id, text); a longer document is a shard of its own.

    Null and empty texts are documents of no words. Repeated rows and null ids
    are documents like any other. Other columns are not read.
    """

    def shard_row(part: int, number: int, ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        code: dict[bytes, int] = {}
        lengths = np.fromiter(map(len, texts), np.int32, len(texts))
        total = int(lengths.sum())
        codes = np.fromiter((code.setdefault(w, len(code)) for w in chain.from_iterable(texts)), np.int32, total)
        # each word's place: its number among the words, and one more for each document before its own
        places = np.arange(total, dtype=np.int32) + np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(code))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"{part}-{number}"], pa.string()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int32())),
                pa.array([list(code)], pa.list_(pa.binary())),
                pa.array([ends.tobytes()], pa.binary()),
                pa.array([places[order].tobytes()], pa.binary()),
            ],
            ["shard", "doc_ids", "n_words", "terms", "ends", "positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id"), batch.column("raw"), strict=True):
                words = (raw.as_py() or b"").translate(WORD_BYTES).split()
                if ids and held + len(words) > shard_words:
                    yield shard_row(part, number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id.as_py())
                texts.append(words)
                held += len(words)
        if ids:
            yield shard_row(part, number, ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, INDEX_SCHEMA)


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; of fewer words, but not none, the one run."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Shard:
    """One row of the index, in one task."""

    def __init__(self, terms: pa.Array, ends: bytes, positions: bytes, n_words: np.ndarray):
        self.terms, self.ends = terms, np.frombuffer(ends, np.int32)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int32) if len(self.ends) else self.ends
        self.positions = np.frombuffer(positions, np.int32)
        self.n_words = n_words
        self.starts = np.concatenate([[0], np.cumsum(n_words.astype(np.int64) + 1)])

    def codes(self, vocabulary: pa.Array) -> np.ndarray:
        """The shard's number of each term, -1 where it doesn't occur."""
        return pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def postings(self, code: int) -> np.ndarray:
        return self.positions[self.begins[code] : self.ends[code]]

    def phrase(self, codes: list[int]) -> np.ndarray:
        """Places where the terms stand one after another."""
        order = sorted(range(len(codes)), key=lambda i: self.ends[codes[i]] - self.begins[codes[i]])
        at = self.postings(codes[order[0]]) - order[0]
        for i in order[1:]:
            if not len(at):
                break
            found = self.postings(codes[i])
            slot = np.searchsorted(found, at + i)
            at = at[found[np.minimum(slot, len(found) - 1)] == at + i]
        return at

    def near(self, codes: list[int], width: int) -> np.ndarray:
        """Places of the rarest term which have all the others at most ``width`` words away."""
        order = sorted(set(codes), key=lambda c: self.ends[c] - self.begins[c])
        at = self.postings(order[0])
        doc = self.docs_at(at)
        for c in order[1:]:
            found = self.postings(c)
            low = np.searchsorted(found, np.maximum(at - width, self.starts[doc]))
            ok = (low < len(found)) & (found[np.minimum(low, len(found) - 1)] <= np.minimum(at + width, self.starts[doc + 1] - 2))
            at, doc = at[ok], doc[ok]
        return at

    def docs_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _shards(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            yield row["shard"].as_py(), row["doc_ids"].values, Shard(row["terms"].values, row["ends"].as_py(), row["positions"].as_py(), row["n_words"].values.to_numpy(zero_copy_only=False))


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items (item_id, words) in blocks that hold at most ``block_words`` words, or one item."""
    block, held = [], 0
    for item_id, raw in benchmark.select("item_id", F.col("text").cast("binary")).toLocalIterator():
        words = word_tokens(bytes(raw or b""))
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        if words:
            block.append((item_id, words))
            held += len(words)
    yield block


def _search_block(index: DataFrame, block: list[tuple[object, list[bytes]]], size: int) -> DataFrame:
    windows: dict[tuple[bytes, ...], set] = {}
    for item_id, words in block:
        for w in windows_of(words, size):
            windows.setdefault(w, set()).add(str(item_id))
    terms = sorted({t for w in windows for t in w})
    number = {t: i for i, t in enumerate(terms)}
    # a row per window; shorter ones end with the number after the last term, which stands for no word
    grid = np.full((len(windows), size), len(terms), np.int32)
    for i, w in enumerate(windows):
        grid[i, : len(w)] = [number[t] for t in w]
    sent = index.sparkSession.sparkContext.broadcast((terms, grid, [sorted(x) for x in windows.values()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries, items = sent.value
        vocabulary = pa.array(vocabulary, pa.binary())
        for name, doc_ids, shard in _shards(batches):
            n = len(shard.n_words)
            marks = np.zeros(int(shard.starts[-1]) + size + 1, np.int32)
            found_items: dict[int, set] = {}
            # the shard's numbers of the terms: -1 for one that it lacks, and -2 for no word
            local = np.append(shard.codes(vocabulary) if len(vocabulary) else np.zeros(0, np.int64), -2)[queries]
            for q in np.flatnonzero((local != -1).all(axis=1)).tolist():
                codes = local[q][local[q] >= 0].tolist()
                at = shard.phrase(codes)
                if len(at):
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + len(codes), -1)
                    for d in np.unique(shard.docs_at(at)).tolist():
                        found_items.setdefault(d, set()).update(items[q])
            hit = np.cumsum(marks) > 0
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8)]))
            begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of = shard.docs_at(begins)
            spans: dict[int, list] = {}
            for d, b, e in zip(of.tolist(), (begins - shard.starts[of]).tolist(), (ends - shard.starts[of]).tolist(), strict=True):
                spans.setdefault(d, []).append({"begin": b, "end": e})
            for low in range(0, n, 4096):
                docs = range(low, min(n, low + 4096))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(docs), pa.string()),
                        pa.array(docs, pa.int32()),
                        doc_ids.slice(low, len(docs)),
                        pa.array(shard.n_words[low : low + len(docs)], pa.int64()),
                        pa.array([spans.get(d, []) for d in docs], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                        pa.array([sorted(found_items.get(d, ())) for d in docs], pa.list_(pa.string())),
                    ],
                    ["shard", "ordinal", "doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, "shard string, ordinal int, doc_id long, n_words long, spans array<struct<begin:int,end:int>>, items array<string>")


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 1_000_000) -> DataFrame:
    """Exact phrase matches of all windows of ``benchmark`` (item_id, text).

    Returns a row per document of the index: doc_id, n_words, n_hit, spans
    (word ranges that windows cover, merged) and items (ids of the items whose
    windows occur, as sorted strings). A null or empty benchmark text has no
    window; with an empty benchmark nothing is hit. An item_id that repeats is
    one item. ``index`` must be a stored table if the benchmark has more words
    than ``block_words``, as the blocks' hits are then merged by its rows.
    """
    found = None
    for block in benchmark_blocks(benchmark, block_words):
        part = _search_block(index, block, window)
        found = part if found is None else found.unionByName(part)
        blocks = 1 if found is part else blocks + 1
    places = lambda spans: F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["begin"])
    if blocks == 1:
        return found.select("doc_id", "n_words", places(F.col("spans")).cast("long").alias("n_hit"), "spans", "items")
    joined = found.groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.expr("""aggregate(all_spans, cast(array() as array<struct<begin:int,end:int>>), (m, s) ->
        case when size(m) > 0 and element_at(m, -1).end >= s.begin
             then concat(slice(m, 1, size(m) - 1), array(named_struct('begin', element_at(m, -1).begin, 'end', greatest(element_at(m, -1).end, s.end))))
             else concat(m, array(s)) end)""")
    joined = joined.withColumn("spans", merged)
    return joined.select("doc_id", "n_words", places(F.col("spans")).cast("long").alias("n_hit"), "spans", "items")


def proximity(index: DataFrame, benchmark: DataFrame, terms: int = 4, width: int = 8, block_words: int = 1_000_000) -> DataFrame:
    """Documents in which an item's ``terms`` rarest terms stand at most ``width`` words from the rarest.

    The rarest terms are those of the shard at hand. Returns doc_id, item_id
    (as a string) and places, the word positions of the rarest term. Items of
    which a term is missing in a shard have no match there.
    """
    found = None
    for block in benchmark_blocks(benchmark, block_words):
        vocabulary = sorted({w for _, words in block for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        sent = index.sparkSession.sparkContext.broadcast((vocabulary, [(str(i), sorted({number[w] for w in words})) for i, words in block]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary, queries = sent.value
            vocabulary = pa.array(vocabulary, pa.binary())
            for _, doc_ids, shard in _shards(batches):
                local = shard.codes(vocabulary).tolist() if len(vocabulary) else []
                out = []
                for item_id, query in queries:
                    codes = [local[t] for t in query]
                    if min(codes) < 0:
                        continue
                    rare = sorted(codes, key=lambda c: (shard.ends[c] - shard.begins[c], c))[:terms]
                    at = shard.near(rare, width)
                    of = shard.docs_at(at)
                    for d in np.unique(of).tolist():
                        out.append((doc_ids[d].as_py(), item_id, (at[of == d] - shard.starts[d]).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["doc_id", "item_id", "places"])

        part = index.mapInArrow(run, "doc_id long, item_id string, places array<int>")
        found = part if found is None else found.unionByName(part)
    return found


def store_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs``, written to the shared folder."""
    return cut(build_index(docs), "postings")
