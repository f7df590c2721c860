"""Dedup of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Of the suffixes of a text only those are kept that a window of ``length`` bytes
cannot miss: the window's seed is the place, in it, where the fingerprint of
``seed`` bytes is least (the first such place). Equal windows have equal seeds
at equal offsets, so a repeated window always meets another suffix with the
same first ``seed`` bytes. A batch's suffix array holds one entry for each seed,
in the order of its first three bytes, then of its fingerprint: equal prefixes
stand together all the same, and an entry takes 8 bytes instead of hundreds. A
new batch is merge-scanned against every existing level, then becomes the lowest
level; levels of about equal size merge, so there are logarithmically many.

Seeds that occur once are settled. For the others, the windows that share a
seed are settled as a whole where all their bytes repeat, else in classes of
``step`` windows, else one by one; one of each settled group goes on to the next
step where it may still be the partner of an unsettled one. Each step counts fingerprints with map-side
combining and joins the counts back, so no task ever holds all occurrences of a
common passage, and texts that are equal as a whole enter once. Fingerprints
are 64-bit random linear hashes of the bytes. What is removed has matched twice,
by the fingerprint of the bytes that a group shares and by that of all its
bytes, so a chance match needs two texts that already share a hundred bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, shared_path, text_or_empty

LENGTH, SEED, STEP = 400, 100, 25
#: Shares of the batches in which a table is indexed; each is over twice the next, so that several levels stand.
BATCHES = (11, 4, 1)
CHUNK = 1 << 16
#: Constants of the splitmix64 generator, which makes the hashes' random numbers.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
ENTRY = "array<struct<h:long,w:long,seed:int,first:int,last:int>>"


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(SPLITMIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SPLITMIX[2])
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(SPLITMIX[0]))
BASE = int(mixed(np.array([77], np.uint64))[0]) | 1
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE, and their inverses, for the longest chunk."""
    if not _powers:
        n = CHUNK + 2 * LENGTH
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers[0], _powers[1]


class Hashed:
    """Fingerprints of a byte string's substrings."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers()
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def all(self, size: int) -> np.ndarray:
        """Of every substring of ``size`` bytes."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def first_least(values: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` values, the place of the first least one."""
    at, reach = np.arange(len(values), dtype=np.int32), 1
    steps = []
    while reach * 2 <= size:
        steps.append(reach)
        reach *= 2
    for shift in [*steps, size - reach]:
        if shift:
            take = values[shift:] < values[:-shift]
            values = np.where(take, values[shift:], values[:-shift])
            at = np.where(take, at[shift:], at[:-shift])
    return at


def tagged(h: np.ndarray, *numbers: np.ndarray) -> np.ndarray:
    """``h`` with small numbers mixed in."""
    for x in numbers:
        h = mixed(h ^ (x.astype(np.uint64) + np.uint64(1)) * np.uint64(SPLITMIX[0]))
    return h


def ordered(data: np.ndarray, place: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The key of the suffixes at ``place``: three bytes, then 40 bits of ``h``; in order as signed numbers."""
    head = sum(data[place + k].astype(np.uint64) << np.uint64(56 - 8 * k) for k in range(3))
    return (head ^ np.uint64(1 << 63)) | (h >> np.uint64(24))


def entries_of(raw: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(h, w, seed, first, last) of the sparse suffixes of ``raw``.

    The windows that begin at first..last have their seed at ``seed``; h is the
    seed's key, w the fingerprint of all bytes of those windows.
    """
    data, found = np.frombuffer(raw, np.uint8), []
    for begin in range(0, len(data) - length + 1, CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        hashed = Hashed(part)
        h = hashed.all(seed)
        at = first_least(h, length - seed + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        place = at[first].astype(np.int64)
        w = tagged(hashed.of(first, last + length), place - first, last - first)
        found.append((ordered(part, place, h[place]), w, place + begin, first + begin, last + begin))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _entry_array(per_text: list[tuple[np.ndarray, ...]]) -> pa.Array:
    columns = [np.concatenate([x[i] for x in per_text]) if per_text else np.zeros(0, np.int64) for i in range(5)]
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
    values = [pa.array(c.view(t) if c.dtype == np.uint64 else c.astype(t)) for c, t in zip(columns, kinds, strict=True)]
    ends = np.cumsum([0] + [len(x[0]) for x in per_text]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, ["h", "w", "seed", "first", "last"]))


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    raw = text_or_empty().cast("binary")
    return docs.select(*more, F.unhex(F.md5(raw)).alias("digest"), raw.alias("raw"))


def text_entries(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """A row per distinct text of ``docs``: digest, copies, entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                found = [entries_of(x.as_py(), length, seed) for x in batch.column("raw")]
                yield pa.RecordBatch.from_arrays([batch.column("digest"), _entry_array(found)], ["digest", "entries"])

    rows = cut(_texts(docs).mapInArrow(run, f"digest binary, entries {ENTRY}"), "suffixes")
    return cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("entries").alias("entries")), "texts")


class SuffixLevels:
    """Levels of the index, each a stored table of entries in the order of h, largest first."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.repeated = spark, [], None

    def _write(self, entries: DataFrame) -> tuple[int, DataFrame]:
        path = shared_path(self.spark, "level")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # by range of h, then of the place, so that a passage which a third of all texts share is dealt over many tasks
        entries.repartitionByRange(parts, "h", "digest", "first").sortWithinPartitions("h", "digest", "first").write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(entries.schema).parquet(path)
        return table.count(), table

    def add(self, entries: DataFrame) -> None:
        """Takes a batch of entries: notes which h repeat in it or meet a level, then stores it as a level."""
        size, batch = self._write(entries)
        if not size:
            return
        counts = batch.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        found = [counts.where("n > 1").select("h")]
        for _, level in self.levels:
            found.append(counts.select("h").join(level.select("h").distinct().hint("merge"), "h", "left_semi"))
        for keys in found:
            self.repeated = keys if self.repeated is None else self.repeated.unionByName(keys)
        self.repeated = cut(self.repeated.distinct(), "repeated")
        self.levels.append((size, batch))
        while len(self.levels) > 1 and self.levels[-2][0] < 2 * self.levels[-1][0]:
            (_, a), (_, b) = self.levels[-2:]
            self.levels[-2:] = [self._write(a.unionByName(b))]

    def entries(self) -> DataFrame | None:
        """Entries of all levels whose h occurs more than once."""
        found = None
        for _, level in self.levels:
            found = level if found is None else found.unionByName(level)
        return None if found is None else found.join(self.repeated, "h", "left_semi")


def _mark(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` with n, the number of rows that have the same ``key``, and ``proxy``, true for one of them."""
    rows = cut(rows, f"keyed-{key[-1]}")
    own = F.struct("digest", "first")
    counts = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("least")).where("n > 1"), f"counts-{key[-1]}")
    return rows.join(counts, list(key), "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("proxy", F.coalesce(own == F.col("least"), F.lit(True))).drop("least")


def _unsettled(marked: DataFrame, key: str) -> DataFrame:
    """Rows of ``marked`` that stand alone, and one row of each settled group that shares ``key`` with such a row."""
    alone = marked.where("n = 1")
    partners = marked.where("n > 1 and proxy").join(alone.select(key).distinct(), key, "left_semi")
    return alone.unionByName(partners.select(*alone.columns))


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED, step: int = STEP, batches: tuple[int, ...] = BATCHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, runs, shared).

    texts has digest and copies; runs has digest and first..last, the begins of
    windows that occur elsewhere in another or the same text; shared has digest
    and n_shared, the number of its suffixes whose first ``seed`` bytes do.
    ``batches`` are the shares of the batches in which the texts are indexed.
    """
    texts = text_entries(docs, length, seed)
    index, place, low = SuffixLevels(docs.sparkSession), F.pmod(F.crc32("digest"), F.lit(sum(batches))), 0
    for share in batches:
        own = texts.where((place >= low) & (place < low + share))
        index.add(own.select("digest", F.explode("entries").alias("e")).select("e.h", "digest", "e.w", "e.seed", "e.first", "e.last"))
        low += share
    copies = texts.select("digest", "copies")
    entries = index.entries()
    if entries is None:
        spark = docs.sparkSession
        return copies, spark.createDataFrame([], "digest binary, first int, last int"), spark.createDataFrame([], "digest binary, n_shared long")
    marked = cut(_mark(entries, "h", "w"), "marked")
    shared = marked.groupBy("digest").agg(F.count(F.lit(1)).alias("n_shared"))
    whole = marked.where("n > 1").select("digest", "first", "last")
    open_ = _unsettled(marked, "h").groupBy("digest").agg(F.collect_list(F.struct("seed", "first", "last")).alias("open"))
    contexts = cut(_contexts(_texts(docs).join(cut(open_, "open"), "digest"), length), "contexts")
    classes = cut(_mark(_classes(contexts, length, step), "k", "w"), "classes")
    by_class = classes.where("n > 1").select("digest", "first", "last")
    rest = _mark(_unsettled(classes, "k").select("digest", "context", "first", "last", "k"), "k").where("n > 1")
    rest = cut(rest.groupBy("digest", "context").agg(F.collect_list(F.struct("first", "last")).alias("open")), "open-classes")
    opened = contexts.select("digest", F.col("first").alias("context"), "bytes").join(rest, ["digest", "context"])
    singles = _mark(_windows(opened, length), "half", "k").where("n > 1")
    return copies, whole.unionByName(by_class).unionByName(singles.select("digest", "first", F.col("first").alias("last"))), shared


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the windows of each open entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, raw, entries in zip(batch.column("digest"), batch.column("raw"), batch.column("open"), strict=True):
                digest, raw = digest.as_py(), raw.as_py()
                out += [(digest, e["seed"], e["first"], e["last"], raw[e["first"] : e["last"] + length]) for e in entries.as_py()]
                if len(out) > 4096:
                    yield rows(out)
                    out = []
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["digest", "seed", "first", "last", "bytes"])

    return texts.select("digest", "raw", "open").mapInArrow(run, "digest binary, seed int, first int, last int, bytes binary")


def _classes(contexts: DataFrame, length: int, step: int) -> DataFrame:
    """Classes of ``step`` windows: k is the fingerprint of the bytes they share, w that of all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, of, firsts, lasts, ks, ws = [], [], [], [], [], []
            for digest, seed, first, last, raw in zip(*(batch.column(c).to_pylist() for c in ("digest", "seed", "first", "last", "bytes")), strict=True):
                hashed = Hashed(np.frombuffer(raw, np.uint8))
                c = np.arange((seed - last) // step, (seed - first) // step + 1)
                high, low = np.minimum(c * step + step - 1, seed - first), np.maximum(c * step, seed - last)
                a, b = seed - first - high, seed - first - low  # begins of the class's windows, from the context's begin
                shared = seed - first - c * step
                k = tagged(hashed.of(shared, shared + length - step + 1), c)
                w = tagged(hashed.of(a, b + length), high, low)
                digests += [digest] * len(c)
                of += [first] * len(c)
                firsts.append(a + first)
                lasts.append(b + first)
                ks.append(k.view(np.int64))
                ws.append(w.view(np.int64))
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(of, pa.int32()), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (firsts, lasts)), *(pa.array(np.concatenate(x)) for x in (ks, ws))],
                    ["digest", "context", "first", "last", "k", "w"],
                )

    return contexts.mapInArrow(run, "digest binary, context int, first int, last int, k long, w long")


def _windows(opened: DataFrame, length: int) -> DataFrame:
    """The single windows of the open classes of each context; k is the fingerprint of a window, half that of its first half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, firsts, ks, halves = [], [], [], []
            for digest, context, raw, classes in zip(*(batch.column(c).to_pylist() for c in ("digest", "context", "bytes", "open")), strict=True):
                hashed = Hashed(np.frombuffer(raw, np.uint8))
                k, half = hashed.all(length), hashed.all(length // 2)
                at = np.unique(np.concatenate([np.arange(c["first"], c["last"] + 1) for c in classes]))
                digests += [digest] * len(at)
                firsts.append(at)
                ks.append(k[at - context].view(np.int64))
                halves.append(half[at - context].view(np.int64))
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(np.concatenate(firsts).astype(np.int32)), *(pa.array(np.concatenate(x)) for x in (ks, halves))], ["digest", "first", "k", "half"])

    return opened.select("digest", "context", "bytes", "open").mapInArrow(run, "digest binary, first int, k long, half long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, step: int = STEP, keep_bytes: bool = True, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """Removes each byte covered by a string of ``length`` bytes that also begins anywhere else.

    Returns per row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (begin
    and end of the removed runs), kept (the remaining bytes, null unless
    ``keep_bytes``), kept_sha256 and n_shared, the number of the text's sampled
    suffixes whose first ``seed`` bytes also begin elsewhere (1 at least for a
    copied text of that length): it tells of passages too short to be removed. Null texts count as empty; texts shorter
    than ``length`` lose nothing; rows that repeat a text of ``length`` bytes or
    more lose all of it. Null and repeated doc_ids pass through, other columns
    are not read, an empty table gives no rows.
    """
    texts, runs, shared = repeated_windows(docs, length, seed, step, batches)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    grouped = runs.groupBy("digest").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    copied = texts.where("copies > 1").join(shared, "digest", "full_outer").join(grouped, "digest", "full_outer")
    found = cut(copied.select("digest", (F.coalesce("copies", F.lit(1)) > 1).alias("copied"), "runs", "n_shared"), "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                sizes, shares, spans, kept, hashes = [], [], [], [], []
                for raw, copied, windows, n_shared in zip(*(batch.column(c) for c in ("raw", "copied", "runs", "n_shared")), strict=True):
                    raw = raw.as_py()
                    shares.append(max(n_shared.as_py() or 0, int(bool(copied.as_py()) and len(raw) >= seed)))
                    cuts: list[list[int]] = []
                    if copied.as_py() and len(raw) >= length:
                        cuts = [[0, len(raw)]]
                    else:
                        for w in sorted((x["first"], x["last"] + length) for x in windows.as_py() or ()):
                            if cuts and w[0] <= cuts[-1][1]:
                                cuts[-1][1] = max(cuts[-1][1], w[1])
                            else:
                                cuts.append(list(w))
                    edges = [0, *(x for c in cuts for x in c), len(raw)]
                    rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    sizes.append(len(raw))
                    spans.append([{"begin": a, "end": b} for a, b in cuts])
                    kept.append(rest if keep_bytes else None)
                    hashes.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shares, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()), pa.array(hashes, pa.string())],
                    ["doc_id", "n_bytes", "n_shared", "spans", "kept", "kept_sha256"],
                )

    rows = _texts(docs, "doc_id").join(found, "digest", "left").select("doc_id", "raw", "copied", "runs", "n_shared")
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_shared long, spans array<struct<begin:int,end:int>>, kept binary, kept_sha256 string")
