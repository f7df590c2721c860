"""SimHash near-dedup with vantage-point trees.

Distinct fingerprints are linked where they differ in few bits, and the links'
connected components are found by alternating large-star and small-star steps.

A vantage-point tree over whole 64-bit fingerprints prunes next to nothing:
distances from any point bunch around 32 with a deviation of 4, so 62 % of the
points lie within 3 of the median radius. The trees therefore stand on a
coarser metric first. Fingerprints that differ in at most k bits of m bands agree
in m - k bands at least; the distance within those is bounded by the whole
distance, so the shards are the balls of radius 0 of each choice of m - k bands.
Of a choice as many bits are compared as leave about ``ball`` fingerprints
together, and there are more bands when the corpus has outgrown the bits.
Crowded balls are cut once more by the Hamming distance to vantage points, in
rings as wide as k + 1; a fingerprint whose distance lies within k of the next
ring also visits that ring. By the triangle inequality two fingerprints within k
of each other meet in some shard. Inside a shard a vantage-point tree finds the
exact pairs, and the shard gives a spanning forest of them, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, lower_words, text_or_empty

BITS = 64
#: Fingerprints of a shard up to which no tree is built; parts into which a node's links are dealt.
LEAF, SALTS = 16, 8


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: a bit is set if it is in over half of the shingles' hashes."""
    words = lower_words(text)
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    digest, counts, half = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), n / 2
    for low in range(0, n, 4096):
        hashes = np.array([digest(line[b:e], seed) for b, e in zip(begins[low : low + 4096], stops[low : low + 4096], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts > half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, row: str | None = None) -> DataFrame:
    """doc_id, the column ``row`` if one is named, and fp (the fingerprint as a signed long) of every row; null texts count as empty."""
    passed = ["doc_id"] if row is None else ["doc_id", row]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("raw")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(fps.view(np.int64))], [*passed, "fp"])

    return docs.select(*passed, text_or_empty().cast("binary").alias("raw")).mapInArrow(run, f"{kinds}, fp long")


class VantageTree:
    """Exact range search in Hamming space; nodes are split at the median distance to their first point."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) > LEAF:
            away = np.bitwise_count(self.points[rows] ^ self.points[rows[0]]).astype(np.int64)
            radius = int(np.median(away))
            inner = away <= radius
            if inner.all():
                inner = away < radius
            if inner.any() and not inner.all():
                self.nodes[at] = (rows[0], radius if (away <= radius).sum() == inner.sum() else radius - 1, self._build(rows[inner]), self._build(rows[~inner]))
                return at
        self.nodes[at] = (rows,)
        return at

    def pairs(self, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows within ``reach``, leaf by leaf; the queries of a leaf descend together."""
        todo = [(self.root, np.arange(len(self.points)))]
        while todo:
            at, queries = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                rows = node[0]
                for low in range(0, len(queries), 1 << 14):
                    some = queries[low : low + (1 << 14)]
                    q, r = np.nonzero(np.bitwise_count(self.points[some][:, None] ^ self.points[rows][None, :]) <= reach)
                    a, b = some[q], rows[r]
                    yield a[a < b], b[a < b]
                continue
            vantage, radius, inner, outer = node
            away = np.bitwise_count(self.points[queries] ^ self.points[vantage]).astype(np.int64)
            todo.append((inner, queries[away <= radius + reach]))
            todo.append((outer, queries[away > radius - reach]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each row is connected with."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(n)], np.int64)


def _links_of_shard(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what is connected within one shard of distinct fingerprints."""
    pairs = VantageTree(points).pairs(reach)
    root = forest(len(points), pairs)
    linked = np.flatnonzero(root != np.arange(len(points)))
    return points[root[linked]], points[linked]


def shard_links(shards: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Links within each shard; ``shards`` has ``keys`` and fp, and the shards are dealt out by ``keys``."""
    dealt = shards.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(block: pa.Table, last: bool):
            """Links of the whole shards in ``block``; the rest, the last shard unless it is complete."""
            n = block.num_rows
            cols = [block.column(k).to_numpy() for k in keys]
            fp = block.column("fp").to_numpy().view(np.uint64)
            new = np.zeros(n, bool)
            new[:1] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            begins = np.flatnonzero(new)
            stop = n if last or not n else int(begins[-1])
            begins = begins[begins < stop]
            ends = np.append(begins[1:], stop)[: len(begins)]
            a_s, b_s = [], []
            small = ends - begins <= LEAF
            # shards that are one leaf: all of them at once, by the distance of rows in sorted order
            size = np.where(small, ends - begins, 0)
            left = np.zeros(n, np.int64)  # how many rows of its shard follow each row
            if len(begins):
                inside = np.repeat(ends, ends - begins) - np.arange(stop) - 1
                left[:stop] = np.where(np.repeat(small, ends - begins), inside, 0)
            for step in range(1, int(size.max(initial=0))):
                i = np.flatnonzero(left >= step)
                i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= reach]
                a_s.append(fp[i])
                b_s.append(fp[i + step])
            for b, e in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
                a, c = _links_of_shard(np.unique(fp[b:e]), reach)
                a_s.append(a)
                b_s.append(c)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a_s, b_s))
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["a", "b"]), block.slice(stop)

        for batch in batches:
            block = pa.Table.from_batches([batch])
            held = block if held is None else pa.concat_tables([held, block])
            out, held = links(held, False)
            yield out
        if held is not None:
            yield links(held, True)[0]

    return dealt.mapInArrow(run, "a long, b long")


def ball_masks(n: int, reach: int, ball: int) -> list[int]:
    """Masks of which any two of ``n`` fingerprints within ``reach`` agree on one; each leaves about ``ball`` of them together."""
    wanted = max(4, math.ceil(math.log2(max(2, n / ball))))
    bands = reach + 1
    while (bands - reach) * (BITS // bands) < wanted and bands < 2 * reach + 2:
        bands += 1
    edges = [BITS * b // bands for b in range(bands + 1)]
    masks = []
    for chosen in combinations(range(bands), bands - reach):
        # the bits of the chosen bands in turn, as many as wanted
        places = [edges[b] + i for i in range(BITS) for b in chosen if edges[b] + i < edges[b + 1]][:wanted]
        masks.append(sum(1 << p for p in places))
    return masks


def links(fps: DataFrame, reach: int = 3, leaf: int = 1024, vantages: int = 3, ball: int = 256) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in ``fps`` (fp) that give the same components as all pairs within ``reach``."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = ball_masks(fps.count(), reach, ball)
    shards = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("band", "ball"))
    sizes = cut(shards.groupBy("band", "ball").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.struct(F.xxhash64("fp", F.lit(i)), "fp"))["fp"].alias(f"v{i}") for i in range(vantages)]), "balls")
    crowded = sizes.where(F.col("n") > leaf).drop("n")
    # balls that fit one task
    small = shards.join(sizes.where(F.col("n") <= leaf).where("n > 1").select("band", "ball"), ["band", "ball"], "left_semi")
    # crowded balls, by rings around vantage points; the ring's own rows and visitors from the ring below
    ringed = shards.join(crowded, ["band", "ball"])
    for i in range(vantages):
        away = F.bit_count(F.col("fp").bitwiseXOR(F.col(f"v{i}")))
        ring = F.floor(away / (reach + 1))
        ringed = ringed.withColumn(f"r{i}", F.explode(F.when(away % (reach + 1) > 0, F.array(ring, ring + 1)).otherwise(F.array(ring)))).drop(f"v{i}")
    ring_keys = ["band", "ball"] + [f"r{i}" for i in range(vantages)]
    return shard_links(small, ["band", "ball"], reach).unionByName(shard_links(ringed.select(*ring_keys, "fp"), ring_keys, reach)).distinct()


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (u, v) joined with the row of ``least`` (u, m) of each u; a u with many rows is dealt into parts."""
    part = F.pmod(F.xxhash64("v"), F.lit(SALTS))
    every = least.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_part", part).join(every, ["u", "_part"]).drop("_part")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node connected with it.

    Alternates large-star and small-star steps (Kiveris et al., 2014) by joins
    and minima only, so no task holds a node's neighbours; each round is
    written to the shared folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(_with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = _with_least(large, least)
        small = cut(
            linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(),
            "small-star",
        )
        # done when every node hangs on one smaller node and none of those hangs on another
        roots = small.select(F.col("v").alias("u")).distinct()
        done = small.count() == least.count() and small.join(roots, "u", "left_semi").isEmpty()
        edges = small
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def near_dups(docs: DataFrame, reach: int = 3, shingle: int = 3, leaf: int = 1024, row: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Fingerprints that differ in at most ``reach`` bits are linked; component_id
    is the smallest doc_id in the connected component. Texts without words,
    null and empty ones too, have fingerprint zero and link like any other.
    Rows that repeat give repeated rows. A null doc_id counts as larger than
    any other. ``row`` names a column with a key of its own for each row; it is
    returned too, with kept, which marks one row of each component: that of the
    smallest doc_id, then of the smallest key. Other columns are not read; an
    empty table gives no rows.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id")).alias("first_id")
    own = [] if row is None else [F.col(row).alias("first_row")]
    names = ["first_id", *("first_row" for _ in own)]
    rows = cut(fingerprints(docs, shingle, row), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min(F.struct(first, *own)).alias("least")).select("fp", *[f"least.{c}" for c in names]), "distinct-fingerprints")
    edges = cut(links(nodes.select("fp"), reach, leaf), "links")
    named = lambda c: nodes.select(F.col("fp").alias(c), F.struct(*names, "fp").alias(f"{c}_node"))
    edges = edges.join(named("a"), "a").join(named("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    comps = components(edges).select(F.col("node.fp").alias("fp"), F.struct(*[F.col(f"root.{c}") for c in names]).alias("root"))
    roots = nodes.join(comps, "fp", "left").select("fp", F.coalesce("root", F.struct(*names)).alias("root"))
    ids = cut(roots.select("fp", F.col("root.first_id.doc_id").alias("component_id"), *[F.col("root.first_row") for _ in own]), "components")
    return rows.join(ids, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        *([] if row is None else [F.col(row), (F.col(row) == F.col("first_row")).alias("kept")]),
    )
