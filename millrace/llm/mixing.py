"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words in ASCII lower case and one end. Each frequent word is a
path of bits in a Huffman tree; any other word is an escape there and is spelled
bit by bit. A bit of a path is guessed by three predictors: by its node alone, by
the node in the hashed context of the word before, and of the two words before.
A bit of a spelled word has the hashed contexts of one, two and three bytes
before it. A guess enters the mixer in the logistic domain; the set of weights is
gated by how much the contexts have seen and whether all of it was alike. The
weights are learnt over every bit of the training texts in reach.

The counts of the contexts are exact and grow with the corpus: nothing is sent to
all tasks but the codebook. Each task cuts its texts into blocks of tokens,
reduces a block to its distinct triples of two words and the one that follows,
and deals those by hash to ranges. A range sums up its triples and counts the
bits at every node of every context, so it can guess the bits of each triple,
learn its weights over all of them, and then answer each triple of each block
with its cost. A range holds the triples that their hash gives it however the
rows are dealt, and so many that what it learns hangs little on which. A training text's bit is guessed without that bit's own count, so
that a text that was learnt from and one that was held out compare.

Triples go by the hash of the word before. The most frequent words have too many
followers for one range: triples after one of those go by both words before, and
what is known after the frequent word alone is a small table of the first
``HEAD`` bits. After two frequent words they go by those bits as well, and the
context of two words is followed below them.

While a text is scored, its tokens' costs by the mixer and by the nodes alone are
mixed by a trust that its earlier tokens have earned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import crc_mod, cut, text_or_empty

#: The end of a text as a token; no word is empty.
END = b""
#: Predictors of a mixer; classes of what a context has seen; words that count as frequent everywhere, and the bits followed after them.
PREDICTORS, CLASSES, HOT, HEAD = 3, 16, 1024, 8
#: Bits of a key that hold a word; tokens of a block; triples of a range.
WORD_BITS, BLOCK, RANGE = 19, 1 << 20, 1 << 18
#: Ranges from which on some are asked together, as a block would have few questions for each; most ranges of such a group.
APART, TOGETHER = 512, 8
#: log2 of the slots of a table of spelling contexts.
SPELL_LOG = 17
#: Costs are sent in this fraction of a bit.
PART = 512
#: Tokens after which a text's trust in the mixer is refined; the log odds that it begins with, and their bounds.
STEP, TRUST, TRUSTS = 32, 3.0, (-4.0, 8.0)
#: Curvature that holds the learnt weights at the first ones.
RIDGE = 10.0
LIMIT = 1 / 65536
#: Constants of the splitmix64 generator.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(SPLITMIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SPLITMIX[2])
    return x ^ (x >> np.uint64(31))


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, bits, nodes): symbol s goes by the bits[start[s] : start[s] + length[s]] of the nodes at the same places."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    count = len(weights)
    parent, side = np.full(2 * count - 1, -1, np.int32), np.zeros(2 * count - 1, np.uint8)
    for n in range(count, 2 * count - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = n
        side[j] = 1
        heapq.heappush(heap, (a + b, n))
    # the way up from all symbols at once, first to count its steps, then to write them down from the end
    at, length = np.arange(count), np.zeros(count, np.int32)
    while len(live := np.flatnonzero(parent[at] >= 0)):
        length[live] += 1
        at[live] = parent[at[live]]
    start = (np.cumsum(length) - length).astype(np.int32)
    bits, nodes = np.zeros(length.sum(), np.uint8), np.zeros(length.sum(), np.int32)
    at, place = np.arange(count), start + length - 1
    while len(live := np.flatnonzero(place >= start)):
        bits[place[live]] = side[at[live]]
        at[live] = parent[at[live]]
        nodes[place[live]] = at[live] - count
        place[live] -= 1
    return start, length, bits, nodes


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


class Codebook:
    """The tree of the frequent words: their paths, and what the nodes alone say of each bit."""

    def __init__(self, words: list[tuple[bytes, int]], escaped: int, hot: int = HOT, head: int = HEAD):
        words = [x for x in words if x[0] != END] + ([x for x in words if x[0] == END] or [(END, 0)])
        self.words, self.escape = [w for w, _ in words], len(words)
        #: Of each token with a path how often it came; 0 for the escape.
        self.counts = np.array([*(n for _, n in words), 0], np.int64)
        self.weights = np.maximum(1, np.append(self.counts[:-1], escaped))
        self.start, self.length, bits, _ = huffman(self.weights.tolist())
        depth = np.arange(len(bits)) - np.repeat(self.start, self.length)
        code = np.add.reduceat(bits.astype(np.uint64) << (63 - depth).astype(np.uint64), self.start)
        by_code = np.argsort(code)
        self.rank = np.empty(len(code), np.int64)
        self.rank[by_code] = np.arange(len(code))
        #: By place in the order of the paths: the path from the left of 64 bits, its length.
        self.code, self.size = code[by_code], self.length[by_code].astype(np.int64)
        #: Bits of a path that are followed after a frequent word alone, and those bits of each place.
        self.reach, self.head = head, (self.code >> np.uint64(64 - head)).astype(np.int64)
        #: Of each word its number among the frequent ones, or -1; no word before, where a text begins, is one of them.
        frequent = [*np.argsort(-self.weights, kind="stable")[:hot], len(code)]
        self.hot = np.full(len(code) + 1, -1, np.int64)
        self.hot[frequent], self.n_hot = np.arange(len(frequent)), len(frequent)

    def __getstate__(self) -> dict:
        """What is sent; the rest is made from it where it is used."""
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "known", "alone")}

    @cached_property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @cached_property
    def known(self) -> pa.Array:
        return pa.array(self.words, pa.binary())

    @cached_property
    def alone(self) -> tuple[np.ndarray, np.ndarray]:
        """(guess, rest): what each node alone says of the path's bit, and log2 of the probability of a path from there.

        The first is by place in the bits of all paths one after another, the
        second by that plus the symbol's number, and nought at a path's end.
        """
        by_code = np.argsort(self.rank)
        n, at, bits = self.weights[by_code], self.start[by_code], int(self.length.sum())
        guess, cost = np.zeros(bits, np.float32), np.zeros(bits + 1)
        for idx, sizes, d, whole, part in followed(self, np.zeros(len(n), np.int64), np.arange(len(n)), n, np.ones(len(n), bool)):
            p = np.repeat(np.clip(part / whole, LIMIT, 1 - LIMIT), sizes)
            guess[at[idx] + d], cost[at[idx] + d] = stretch(p), np.log2(p)
        ends = np.cumsum(cost)
        last = np.repeat(ends[self.start + self.length - 1], self.length + 1)
        own = np.repeat(np.arange(len(self.length)), self.length + 1)
        place = np.arange(len(own)) - own
        return guess, np.where(place == (self.start + self.length)[own], 0, last - np.append(0.0, ends[:-1])[place])

    @property
    def guess(self) -> np.ndarray:
        return self.alone[0]

    @property
    def rest(self) -> np.ndarray:
        return self.alone[1]


def followed(book: Codebook, context: np.ndarray, rank: np.ndarray, total: np.ndarray, lone: np.ndarray) -> Iterator[tuple]:
    """The nodes on the way to each pair of context and word, level by level.

    The pairs are in the order of context and rank. Gives (pairs, how many stand
    on each side of a node in turn, depth, count at each node, count on that side
    of it) while a node has a count of two, or of one if a pair below it is
    ``lone``.
    """
    limit, code = book.size[rank], book.code[rank]
    #: The bits that each pair's path shares with that of the pair before, or -1 where a context begins.
    shared = np.full(len(rank), -1, np.int8)
    apart_at = code[1:] ^ code[:-1]
    # the bit below the first is cleared, so that no rounding reaches the next power of two
    shared[1:] = np.where(context[1:] == context[:-1], 64 - np.frexp((apart_at & ~(apart_at >> np.uint64(1))).astype(np.float64))[1], -1)
    # pairs below a node stand together, and go together once it is left
    sums, lones = np.append(0, np.cumsum(total)), np.append(0, np.cumsum(lone))
    idx, depth, above = np.arange(len(rank), dtype=np.int32), 0, None
    while len(idx):
        starts = np.flatnonzero(shared < depth)
        sizes = np.diff(np.append(starts, len(idx)))
        first = idx[starts]
        count = sums[first + sizes] - sums[first]
        if depth:
            yield idx, sizes, depth - 1, above[np.cumsum(shared[starts] < depth - 1) - 1], count
        stays, few = limit[first] > depth, np.flatnonzero(count < 2)
        stays[few] &= (count[few] == 1) & (lones[(first + sizes)[few]] > lones[first[few]])
        keep = np.flatnonzero(np.repeat(stays, sizes))
        idx, shared, above, depth = idx[keep], shared[keep], count[stays], depth + 1


#: The counts that a byte stands for: up to 31 as they are, then eight to each doubling.
COUNT = np.array([*range(32), *(round(32 * 2 ** (k / 8)) for k in range(224))], np.float64)


def _in_a_byte(n: np.ndarray) -> np.ndarray:
    return np.where(n < 32, n, 32 + np.minimum(223, np.rint(8 * np.log2(np.maximum(n, 32) / 32)))).astype(np.uint16)


BYTE = _in_a_byte(np.arange(1 << 16))


def in_a_byte(n: np.ndarray) -> np.ndarray:
    if not len(n) or n.max() < len(BYTE):
        return BYTE[n]
    out, large = BYTE[np.minimum(n, len(BYTE) - 1)], np.flatnonzero(n >= len(BYTE))
    out[large] = _in_a_byte(n[large])
    return out


def packed(same: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How often a node saw the bit that came, and the other, in 16 bits."""
    return in_a_byte(same) << 8 | in_a_byte(other)


def _meaning() -> tuple[np.ndarray, np.ndarray]:
    same, other = COUNT[np.arange(65536) >> 8], COUNT[np.arange(65536) & 255]
    n = same + other
    guess = np.where(n > 0, np.clip(stretch((same + 0.4) / (n + 0.8)), -8, 8), 0).astype(np.float32)
    seen = np.minimum(7, np.ceil(np.log2(n + 1))).astype(np.int64)
    return guess, np.where(n > 0, seen * 2 + (np.minimum(same, other) > 0), 0).astype(np.int16)


#: What each packed value says: its guess for the bit that came, in the logistic domain, and the class of its context.
GUESS, CLASS = _meaning()


@dataclass
class Bits:
    """Bits to guess: the set of weights of each, the predictors' guesses for what came, and the owner."""

    sets: np.ndarray
    guesses: list[np.ndarray]
    owner: np.ndarray


def first_weights() -> np.ndarray:
    return np.tile([0.4, 0.3, 0.4], (CLASSES * CLASSES, 1))


def mixed_guess(weights: np.ndarray, bits: Bits) -> np.ndarray:
    narrow, sets = weights.astype(np.float32), bits.sets.astype(np.intp)
    z = narrow[:, 0].copy()[sets] * bits.guesses[0]
    for k in range(1, len(bits.guesses)):
        z += narrow[:, k].copy()[sets] * bits.guesses[k]
    return z


def slopes(weights: np.ndarray, bits: Bits, times: np.ndarray) -> np.ndarray:
    """By set of weights: the slopes of the log probability of what came, ``times`` for each owner, then its curvatures, pair by pair of predictors."""
    p = 1 / (1 + np.exp(-mixed_guess(weights, bits)))
    n, sets, size, out = times[bits.owner], bits.sets.astype(np.intp), len(weights), []
    error = n * (1 - p)
    spread = error * p
    out += [np.bincount(sets, error * g, size) for g in bits.guesses]
    for k, g in enumerate(bits.guesses):
        spread_g = spread * g
        out += [np.bincount(sets, spread_g * h, size) for h in bits.guesses[: k + 1]]
    return np.stack(out, axis=1)


def improved(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A Newton step of every set of weights."""
    out = weights.copy()
    for s in range(len(weights)):
        curve = np.zeros((PREDICTORS, PREDICTORS))
        curve[np.tril_indices(PREDICTORS)] = sums[s, PREDICTORS:]
        curve = curve + np.tril(curve, -1).T + RIDGE * np.eye(PREDICTORS)
        out[s] += np.clip(np.linalg.solve(curve, sums[s, :PREDICTORS]), -0.5, 0.5)
    return np.round(out, 9)


def cost(weights: np.ndarray, bits: Bits, owners: int) -> np.ndarray:
    """log2 of the probability of each owner's bits."""
    p = np.clip(1 / (1 + np.exp(-mixed_guess(weights, bits))), LIMIT, 1 - LIMIT)
    return np.bincount(bits.owner, np.log2(p), owners)


def trusted(alone: np.ndarray, mixer: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log2 of the probability of each text, whose tokens stand together: a mean of the nodes' and the mixer's for each token.

    The mixer's share is what the tokens of the steps before have earned, in log
    odds within bounds.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    steps = -(-sizes // STEP)
    last = np.cumsum(steps)
    first = np.repeat(last - steps, steps)
    edges = np.repeat(begins, steps) + (np.arange(last[-1]) - first) * STEP
    gain = np.add.reduceat((mixer - alone) * math.log(2), edges)
    running = np.cumsum(gain)
    before = running - gain - np.where(first > 0, running[first - 1], 0)
    odds = np.repeat(np.clip(TRUST + before, *TRUSTS), np.diff(np.append(edges, ends[-1])))
    share = 1 / (1 + np.exp(-odds))
    return np.add.reduceat(np.log2(share * np.exp2(mixer) + (1 - share) * np.exp2(alone)), begins)


# -- words: blocks of tokens, the ranges of their triples, and the answers


def triples(book: Codebook, tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each token a key of the word before, the one before that, and its own."""
    one = np.roll(tokens, 1)
    one[begins] = book.escape + 1
    two = np.roll(one, 1)
    two[begins] = book.escape + 1
    return one << 2 * WORD_BITS | two << WORD_BITS | tokens


def apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word before that, word) of keys."""
    low = (1 << WORD_BITS) - 1
    return keys >> 2 * WORD_BITS, keys >> WORD_BITS & low, keys & low


def dealt(book: Codebook, keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each triple."""
    one, two, own = apart(keys)
    hot = book.hot[one] >= 0
    also_two = np.where(hot, two + 1, 0)
    also_head = np.where(hot & (book.hot[two] >= 0), book.head[book.rank[own]] + 1, 0)
    h = one.astype(np.uint64)
    for more in (also_two, also_head):
        h = mixed(h * np.uint64(SPLITMIX[0]) + more.astype(np.uint64))
    return (h >> np.uint64(44)).astype(np.int64) * ranges >> 20


def ragged(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each row, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


SQUEEZE, EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of one length, each byte by byte of equal place; a byte that is nought everywhere takes no room."""
    planes = []
    for c in columns:
        used = int(np.bitwise_or.reduce(c)) if len(c) else 0
        raw = c.view(np.uint8).reshape(len(c), c.itemsize).T
        planes += [SQUEEZE.compress(raw[k].tobytes()) if used >> 8 * k & 255 else b"" for k in range(c.itemsize)]
    return np.array([len(columns[0]), *map(len, planes)], "<u4").tobytes() + b"".join(planes)


def unsqueezed(raw: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, *lengths = np.frombuffer(raw, "<u4", 1 + sum(sizes)).tolist()
    out, planes, at = [], iter(lengths), 4 + 4 * sum(sizes)
    for kind, size in zip(kinds, sizes, strict=True):
        column = np.zeros((n, size), np.uint8)
        for k in range(size):
            if length := next(planes):
                column[:, k] = np.frombuffer(EXPAND.decompress(raw[at : at + length]), np.uint8)
                at += length
        out.append(column.view(kind).ravel())
    return out


def by_range(to: np.ndarray) -> np.ndarray:
    """The order of ranges, and of places where those are equal: numpy sorts 16 bits at a time by counting."""
    order = np.argsort((to & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((to[order] >> 16).astype(np.uint16), kind="stable")] if len(to) and to.max() > 0xFFFF else order


def distinct(book: Codebook, keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in the order of range and key, their counts, their ranges)."""
    own, counts = np.unique(keys, return_counts=True)
    to = dealt(book, own, ranges)
    order = by_range(to)
    return own[order], counts[order], to[order]


def places(book: Codebook, keys: np.ndarray, ranges: int) -> np.ndarray:
    """The place of each key among the distinct ones in the order of range and key."""
    own, back = np.unique(keys, return_inverse=True)
    place = np.empty(len(own), np.int64)
    place[by_range(dealt(book, own, ranges))] = np.arange(len(own))
    return place[back]


def grouped(ranges: int) -> int:
    """How many ranges are asked together. What blocks ask of groups grows with the square of the corpus; a group's memory bounds this."""
    return max(1, min(TOGETHER, -(-ranges // APART)))


def questions(book: Codebook, keys: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """(group of ranges, payload) of the distinct triples of a block, in the order of range and key, and their counts."""
    own, counts, to = distinct(book, keys, ranges)
    group = to // grouped(ranges)
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(to))
    one, two, word = apart(own)
    step = np.diff(one, prepend=0)
    step[edges[:-1]] = one[edges[:-1]]
    columns = [x.astype(np.uint32) for x in (step, two, word, counts)]
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(group[low]), squeezed(*(x[low:high] for x in columns))


def question(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a payload."""
    one, two, word, counts = unsqueezed(payload, *[np.uint32] * 4)
    # steps back, from range to range, are taken modulo 2^32
    one, two, word = (x.astype(np.int64) for x in (np.cumsum(one, dtype=np.uint32), two, word))
    return one << 2 * WORD_BITS | two << WORD_BITS | word, counts


def answers(book: Codebook, heads: np.ndarray, payloads: list[bytes], held: list[bool], rounds: int, ranges: int) -> list[bytes]:
    """The payload of the answer to each question to one group of ranges, which are taken one by one."""
    asked, together = [question(x) for x in payloads], grouped(ranges)
    sizes = np.array([len(keys) for keys, _ in asked])
    place = dealt(book, np.concatenate([keys for keys, _ in asked]), ranges) % together if together > 1 else 0
    many = np.bincount(np.repeat(np.arange(len(asked)) * together, sizes) + place, minlength=len(asked) * together).reshape(-1, together)
    high = np.cumsum(many, axis=1)
    found = [np.empty(n, np.uint16) for n in sizes.tolist()]
    for r in range(together):
        if own := np.flatnonzero(many[:, r]).tolist():
            parts = [slice(high[k, r] - many[k, r], high[k, r]) for k in own]
            costs = Range(book, heads, [(asked[k][0][x], asked[k][1][x]) for k, x in zip(own, parts, strict=True)], [held[k] for k in own]).costs(rounds)
            for k, x, values in zip(own, parts, costs, strict=True):
                found[k][x] = values
    return [squeezed(x) for x in found]


class Range:
    """The distinct triples of a range and what their contexts know.

    Held-out questions add nothing; the others are guessed without one of their
    own occurrences, so a triple that both ask for is there twice. ``heads`` has
    what came after each frequent word, by the first bits of the follower's path.
    """

    def __init__(self, book: Codebook, heads: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]], held: list[bool]):
        self.book = book
        keys, sizes = np.concatenate([k for k, _ in asked]), [len(k) for k, _ in asked]
        one, two, word = apart(keys)
        sort = (one << 2 * WORD_BITS | two << WORD_BITS | book.rank[word]) << 1 | np.repeat(np.array(held, np.int64), sizes)
        order = np.argsort(sort)
        sort, new = sort[order], np.ones(len(keys), bool)
        new[1:] = sort[1:] != sort[:-1]
        starts = np.flatnonzero(new)
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        self.places = np.split(place, np.cumsum(sizes)[:-1])
        self.held = (sort[starts] & 1).astype(bool)
        self.total = np.where(self.held, 0, np.add.reduceat(np.concatenate([c for _, c in asked]).astype(np.int64)[order], starts))
        self.word = word[order[starts]]
        one, two, rank = apart(sort[starts] >> 1)
        hot, head = book.hot[one], book.head[rank]
        both = (hot >= 0) & (book.hot[two] >= 0)
        #: By order: triples, depth and packed counts, from the root down.
        levels: list[list[tuple]] = [[], []]
        shift = self.held.astype(np.uint32) * np.uint32(16)

        def know(order: int, rows: np.ndarray, sizes: np.ndarray | int, depth: int, whole: np.ndarray, part: np.ndarray) -> None:
            other = in_a_byte(whole - part)
            value = (in_a_byte(part) << 8 | other).astype(np.uint32) << np.uint32(16) | (in_a_byte(np.maximum(part - 1, 0)) << 8 | other)
            value = (np.repeat(value, sizes) >> shift[rows]).astype(np.uint16)
            k = np.flatnonzero(value)  # nought: seen by no other
            levels[order].append((rows[k], depth, value[k]))

        cold = np.flatnonzero(hot < 0)
        # the triples of one word before stand by that of two; in the order of the word after it they can be followed
        by_word = cold[np.argsort(one[cold] << WORD_BITS | rank[cold])].astype(np.int32)
        for i, sizes, d, n, m in followed(book, one[by_word], rank[by_word], self.total[by_word], self.held[by_word]):
            know(0, by_word[i], sizes, d, n, m)
        warm = np.flatnonzero(hot >= 0).astype(np.int32)
        wide = heads.shape[1] + 1
        sums = np.concatenate([np.zeros((len(heads), 1), np.int64), np.cumsum(heads, axis=1)], axis=1).ravel()
        row, bits, size = hot[warm] * wide, head[warm], book.size[rank[warm]]
        whole = sums[row + wide - 1]
        for d in range(book.reach):
            if d:
                live = size > d
                warm, row, bits, size, whole = warm[live], row[live], bits[live], size[live], part[live]
            low = row + (bits >> (book.reach - d - 1) << (book.reach - d - 1))
            part = sums[low + (1 << book.reach - d - 1)] - sums[low]
            know(0, warm, 1, d, whole, part)
        context = (one << WORD_BITS | two) * 2 ** book.reach + np.where(both, head, 0)
        for i, sizes, d, n, m in followed(book, context, rank, self.total, self.held):
            if d < book.reach:
                own = ~both[i[np.cumsum(sizes) - sizes]]
                i, sizes, n, m = i[np.repeat(own, sizes)], sizes[own], n[own], m[own]
            know(1, i, sizes, d, n, m)

        self.depth = np.zeros(len(self.word), np.int32)
        for known in levels:
            deepest = np.zeros_like(self.depth)
            for i, d, _ in known:
                deepest[i] = d + 1
            self.depth = np.maximum(self.depth, deepest)
        ends = np.cumsum(self.depth)
        self.begins = ends - self.depth
        #: The packed counts of each order, triple by triple and bit by bit.
        self.seen = [np.zeros(int(ends[-1]), np.uint16) for _ in range(2)]
        for full, known in zip(self.seen, levels, strict=True):
            for i, d, v in known:
                full[self.begins[i] + d] = v

    def bits(self, held: bool, size: int = 1 << 13) -> Iterator[tuple[np.ndarray, Bits, np.ndarray]]:
        """Parts (triples, their known bits, log2 of the probability of the rest of their paths), for one kind of question."""
        book, own = self.book, np.flatnonzero(self.held == held)
        for low in range(0, len(own), size):
            some = own[low : low + size]
            many = self.depth[some]
            at = ragged(many, self.begins[some])
            start = book.start[self.word[some]].astype(np.int64)
            one, two = (s[at] for s in self.seen)
            part = Bits(CLASS[one] * CLASSES + CLASS[two], [book.guess[ragged(many, start)], GUESS[one], GUESS[two]], np.repeat(np.arange(len(some), dtype=np.int32), many))
            yield some, part, book.rest[start + self.word[some] + many]

    def learnt(self, rounds: int) -> tuple[np.ndarray, list[tuple]]:
        """Weights from all bits of the training questions, and those bits, part by part."""
        weights, parts = first_weights(), list(self.bits(False))
        for _ in range(rounds if parts else 0):
            weights = improved(weights, sum(slopes(weights, bits, self.total[some]) for some, bits, _ in parts))
        return weights, parts

    def costs(self, rounds: int) -> list[np.ndarray]:
        """The answer to each question: minus log2 of the probability of each triple's word, in parts of a bit."""
        weights, parts = self.learnt(rounds)
        found = np.zeros(len(self.word), np.uint16)
        for some, bits, rest in chain(parts, self.bits(True)):
            found[some] = np.minimum(65535, np.rint(-PART * (cost(weights, bits, len(some)) + rest)))
        return [found[p] for p in self.places]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def words_of(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Some rows at a time, of at most ``size`` bytes or one: (rows, their words in lower case, the number of words of each text)."""
    ends = np.cumsum(pc.binary_length(batch.column("raw")).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        some = batch.slice(low, high - low)
        # the bytes are split at white space as they are; a text that begins or ends with it has an empty part there
        found = pc.ascii_split_whitespace(pc.ascii_lower(some.column("raw").cast(pa.binary()).view(pa.string())))
        parts = found.values.view(pa.binary())
        whole = pc.binary_length(parts).to_numpy(zero_copy_only=False) > 0
        if whole.all():
            sizes = np.diff(found.offsets.to_numpy())
        else:
            sizes, parts = np.diff(np.append(0, np.cumsum(whole))[found.offsets.to_numpy()]), parts.filter(pa.array(whole))
        del found, whole
        yield some, parts, sizes
        low = high
    pa.default_memory_pool().release_unused()  # Arrow keeps freed memory, which an executor's other workers need


def blocks_of(book: Codebook, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bool, list, list[int], list[int], np.ndarray, bytes]]:
    """Texts (doc_id, held_out, raw) in blocks: (held, ids, tokens of each, bytes of each, tokens, words without a path). A text is never cut."""
    held_texts: dict[bool, list] = {False: [[], [], [], [], [], 0], True: [[], [], [], [], [], 0]}

    def whole(held: bool) -> tuple:
        *columns, tokens, words, _ = held_texts[held]
        held_texts[held] = [[], [], [], [], [], 0]
        rare = pa.concat_arrays(words)
        return held, *columns, np.concatenate(tokens), pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rare)], pa.int32()), rare), b" ")[0].as_py()

    for rows, words, sizes in (x for batch in batches for x in words_of(batch)):
        found = pc.index_in(words, value_set=book.known).fill_null(book.escape).to_numpy()
        ends = np.cumsum(sizes)
        tokens = np.insert(found, ends, book.index[END])
        rare = np.flatnonzero(found == book.escape)
        escapes, edges = words.take(pa.array(rare)), np.searchsorted(rare, np.append(0, ends)).tolist()
        high = 0
        for k, (doc_id, held, n_bytes, n) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("held_out").to_pylist(), pc.binary_length(rows.column("raw")).to_pylist(), (sizes + 1).tolist(), strict=True)):
            low, high, block = high, high + n, held_texts[held]
            for part, x in zip(block, (doc_id, n, n_bytes, tokens[low:high], escapes.slice(edges[k], edges[k + 1] - edges[k])), strict=False):
                part.append(x)
            block[5] += n
            if block[5] >= size:
                yield whole(held)
    for held, block in held_texts.items():
        if block[0]:
            yield whole(held)


def begins_of(sizes: list[int]) -> np.ndarray:
    return np.cumsum([0, *sizes[:-1]])


def blocks(docs: DataFrame, sent: Broadcast[Codebook], size: int) -> DataFrame:
    """The table of blocks of texts (doc_id, held_out, raw): a row has its texts' ids, sizes and tokens, and their words without a path."""
    kind, name = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("block", pa.string()), ("held", pa.bool_()), ("ids", pa.list_(kind)), ("sizes", pa.list_(pa.int32())), ("n_bytes", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (held, ids, sizes, n_bytes, tokens, words) in enumerate(blocks_of(sent.value, batches, size)):
            yield _batch([{"block": f"{part}-{number}", "held": held, "ids": ids, "sizes": sizes, "n_bytes": n_bytes, "words": zstandard.compress(words, 1), "tokens": squeezed(tokens.astype(np.uint32))}], schema)

    return cut(docs.mapInArrow(run, f"block string, held boolean, ids array<{name}>, sizes array<int>, n_bytes array<int>, words binary, tokens binary"), "blocks")


def _tokens(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sizes of the texts) of a row of the table of blocks."""
    return unsqueezed(batch.column("tokens")[i].as_py(), np.uint32)[0].astype(np.int64), batch.column("sizes")[i].values.to_numpy().astype(np.int64)


def after_frequent(table: DataFrame, sent: Broadcast[Codebook]) -> np.ndarray:
    """How often each frequent word was followed by a path with each of the first bits, in the training texts."""
    n_hot, width = sent.value.n_hot, 1 << sent.value.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, total = sent.value, np.zeros(n_hot * width, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, sizes = _tokens(batch, i)
                one, _, own = apart(triples(book, tokens, begins_of(sizes)))
                hot = book.hot[one]
                total += np.bincount(hot[hot >= 0] * width + book.head[book.rank[own[hot >= 0]]], minlength=len(total))
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])], ["at", "n"])

    got = table.where("not held").select("sizes", "tokens").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # bounded by the frequent words
    heads = np.zeros(n_hot * width, np.int64)
    heads[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return heads.reshape(-1, width)


def asked(table: DataFrame, sent: Broadcast[Codebook], ranges: int) -> DataFrame:
    """The questions of all blocks, those to one group of ranges together."""
    schema = pa.schema([("to", pa.int32()), ("block", pa.string()), ("held", pa.bool_()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, sizes = _tokens(batch, i)
                name, held = batch.column("block")[i].as_py(), batch.column("held")[i].as_py()
                yield _batch([{"to": to, "block": name, "held": held, "payload": x} for to, x in questions(sent.value, triples(sent.value, tokens, begins_of(sizes)), ranges)], schema)

    asking = table.select("block", "held", "sizes", "tokens").mapInArrow(run, "to int, block string, held boolean, payload binary")
    return asking.repartition("to").sortWithinPartitions("to")


def answered(asking: DataFrame, sent: Broadcast[Codebook], heads: Broadcast[np.ndarray], rounds: int, ranges: int = 1) -> DataFrame:
    """(block, to, answer) of all questions; a task holds those to one group of ranges at a time."""
    schema = pa.schema([("block", pa.string()), ("to", pa.int32()), ("answer", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush():
            if rows:
                to, names, held, payloads = zip(*rows, strict=True)
                found = answers(sent.value, heads.value, list(payloads), list(held), rounds, ranges)
                yield _batch([{"block": name, "to": to[0], "answer": x} for name, x in zip(names, found, strict=True)], schema)
                rows.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("to", "block", "held", "payload")), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield from flush()
                rows.append(row)
        yield from flush()

    return asking.mapInArrow(run, "block string, to int, answer binary")


# -- words without a path


class Spelling:
    """Paths of bytes, and counts of the spelling contexts' bits: by the byte before, and hashed by two and three bytes before."""

    SLOTS = (1 << 16, 1 << SPELL_LOG, 1 << SPELL_LOG)

    def __init__(self, byte_counts: np.ndarray):
        self.paths, self.weights = huffman((byte_counts + 1).tolist()), first_weights()
        #: Of each predictor's slots in turn how often a nought and a one came.
        self.counts = np.zeros(2 * sum(self.SLOTS), np.int64)

    @staticmethod
    def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the three bytes before and the byte itself, word) of each byte of the words, each with a space at its end."""
        raw = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        place = ragged(sizes, np.zeros(len(words), np.int64))
        one, two, three = (np.where(place >= k, np.roll(raw, k), 32).astype(np.uint32) for k in (1, 2, 3))
        return three << 24 | two << 16 | one << 8 | raw, np.repeat(np.arange(len(words), dtype=np.int32), sizes)

    def steps(self, letters: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(places in ``counts`` by predictor, letter) of the letters' bits."""
        raw, one, context = (letters & 255).astype(np.int32), (letters >> 8 & 255).astype(np.int32), letters >> 8
        start, length, bits, nodes = self.paths
        many = length[raw]
        at = ragged(many, start[raw])
        of, node = np.repeat(np.arange(len(raw), dtype=np.int32), many), nodes[at]
        found = [(one * 256)[of] + node]
        spread = node.astype(np.uint32) * np.uint32(SPLITMIX[0] >> 32)
        # two bytes with the nearer first, then those and the third
        two = (context & 255) << 8 | context >> 8 & 255
        for k, context in enumerate((two, two << 8 | letters >> 24)):
            h = (mixed(context.astype(np.uint64) + np.uint64(k << 32)) >> np.uint64(32)).astype(np.uint32)[of] + spread
            h ^= h >> np.uint32(15)
            h *= np.uint32(SPLITMIX[2] >> 32 | 1)
            found.append((h >> np.uint32(32 - SPELL_LOG)).astype(np.int32) + (self.SLOTS[0] + k * self.SLOTS[1]))
        return [2 * x + bits[at] for x in found], of

    def slots(self, words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """(places in ``counts`` by predictor, word) of the bits of the words, each with a space at its end."""
        letters, word = self.letters(words)
        found, of = self.steps(letters)
        return found, word[of]

    def guessed(self, places: list[np.ndarray], owner: np.ndarray, learnt_from: np.ndarray) -> Bits:
        less = learnt_from.astype(np.int64)[owner]
        seen = [packed(np.maximum(self.counts[x] - less, 0), self.counts[x ^ 1]) for x in places]
        return Bits(CLASS[seen[1]] * CLASSES + CLASS[seen[2]], [GUESS[v] for v in seen], owner)

    def bits(self, words: list[bytes], learnt_from: np.ndarray) -> Bits:
        """A word that was learnt from is guessed without its own count."""
        return self.guessed(*self.slots(words), learnt_from)

    def cost(self, words: list[bytes], learnt_from: np.ndarray) -> np.ndarray:
        """log2 of the probability of each word's bits; letters that recur are guessed once."""
        letters, word = self.letters(words)
        own, back = np.unique(letters | learnt_from.astype(np.uint64)[word] << np.uint64(32), return_inverse=True)
        bits = self.guessed(*self.steps((own & np.uint64(0xFFFFFFFF)).astype(np.uint32)), own >> np.uint64(32) > 0)
        return np.bincount(word, cost(self.weights, bits, len(own))[back], len(words))


def _words_of(batch: pa.RecordBatch, size: int = 1 << 15, most: int = 1 << 18) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Some words, whether each was learnt from, and their rows; a word of more than ``size`` bytes comes in pieces."""
    tokens, seen = batch.column("token"), batch.column("c").to_numpy() > 0
    lengths = pc.binary_length(tokens).to_numpy()
    if len(lengths) and lengths.max() <= size and lengths.sum() <= most:
        yield tokens.to_pylist(), seen, np.arange(len(lengths))
        return
    words, seen, rows, held = [], [], [], 0
    for row, (token, c) in enumerate(zip(batch.column("token").to_pylist(), batch.column("c").to_pylist(), strict=True)):
        for low in range(0, len(token), size):
            words.append(token[low : low + size])
            seen.append(c > 0)
            rows.append(row)
            held += len(words[-1])
            if held >= most:
                yield words, np.array(seen), np.array(rows)
                words, seen, rows, held = [], [], [], 0
    if words:
        yield words, np.array(seen), np.array(rows)


def spelling(rare: DataFrame, book: Codebook) -> Spelling:
    """The counts over the distinct words (token, c) that were learnt from; paths and weights are those of the codebook's words."""
    model = Spelling(np.bincount(np.frombuffer(b" ".join(book.words), np.uint8), minlength=256))
    empty = rare.sparkSession.sparkContext.broadcast(model)  # bounded by the slots

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(empty.value.counts), np.int64)
        for batch in batches:
            for words, _, _ in _words_of(batch):
                letters, times = np.unique(empty.value.letters(words)[0], return_counts=True)
                found, of = empty.value.steps(letters)
                for at in found:
                    np.add.at(total, at, times[of])
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(total[live])], ["place", "n"])

    got = rare.where("c > 0").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # bounded by the slots
    counts = np.zeros(len(model.counts), np.int64)
    counts[got.column("place").to_numpy()] = got.column("n").to_numpy()
    model.counts = counts
    words = [w for w in book.words if w]
    sums = [slopes(model.weights, model.bits(some, np.zeros(len(some), bool)), np.ones(len(some))) for low in range(0, len(words), 4096) for some in [words[low : low + 4096]]]
    if sums:
        model.weights = improved(model.weights, sum(sums))
    return model


def spelled(rare: DataFrame, model: Spelling) -> DataFrame:
    """(token, c, spelled): log2 of the probability of each word's bits."""
    sent = rare.sparkSession.sparkContext.broadcast(model)  # bounded by the slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for words, seen, rows in _words_of(batch):
                np.add.at(found, rows, sent.value.cost(words, seen))
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("c"), pa.array(found)], ["token", "c", "spelled"])

    return rare.mapInArrow(run, "token binary, c long, spelled double")


# -- the whole


def token_counts(docs: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """(token, c) of all texts (held_out, raw): words in lower case, and END once for each text; c counts what isn't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[pa.Table] = []

        def rows():
            summed = pa.concat_tables(counts).group_by("token", use_threads=False).aggregate([("c", "sum")])
            counts.clear()
            yield from summed.rename_columns({"c_sum": "c"}).select(["token", "c"]).to_batches()

        for some, words, sizes in (x for batch in batches for x in words_of(batch)):
            found, held = words.dictionary_encode(), some.column("held_out").to_numpy(zero_copy_only=False)
            n = np.bincount(found.indices.to_numpy()[~np.repeat(held, sizes)], minlength=len(found.dictionary))
            counts += [pa.table({"token": found.dictionary, "c": n}), pa.table({"token": pa.array([END], pa.binary()), "c": np.array([(~held).sum()])})]
            if sum(t.num_rows for t in counts) > flush:
                yield from rows()
        if counts:
            yield from rows()

    return docs.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def codebook(counts: DataFrame, total: int, words: int, longest: int) -> Codebook:
    """The ``words`` most frequent words of at most ``longest`` bytes that occur twice or more."""
    is_end = F.octet_length("token") == 0
    frequent = counts.where(is_end | (F.col("c") > 1) & (F.octet_length("token") <= longest)).orderBy(F.desc(is_end), F.desc("c"), "token").limit(words)
    found = frequent.toArrow()
    top = list(zip(found.column("token").to_pylist(), found.column("c").to_pylist(), strict=True))
    return Codebook(top, total - sum(n for _, n in top))


def _score_rows(table: DataFrame, replied: DataFrame, sent: Broadcast[Codebook], n_ranges: int) -> DataFrame:
    """Each text's sums over tokens with a path, its other words (rare) and log2 of the probability of its paths."""
    id_type = table.schema["ids"].dataType.elementType.simpleString()
    id_kind = to_arrow_type(table.schema["ids"].dataType.elementType)

    def scored(text: dict, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        tokens, sizes = unsqueezed(text["tokens"], np.uint32)[0].astype(np.int64), np.array(text["sizes"], np.int64)
        place = places(book, triples(book, tokens, begins_of(sizes)), n_ranges)
        costs = np.concatenate([unsqueezed(x, np.uint16)[0] for x in replies])[place] / -PART
        n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        words = pa.array(zstandard.decompress(text["words"]).split(), pa.binary()).dictionary_encode()
        # each text's words once, with their numbers
        own, times = np.unique(owner[tokens == book.escape] * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
        of, word = np.divmod(own, max(1, len(words.dictionary)))
        pairs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(word)), pa.array(times)], ["token", "n"])
        logs, seen = np.log10(book.counts + 1.0), (book.counts > 0).astype(float)
        columns = {
            "doc_id": pa.array(text["ids"], id_kind), "held_out": pa.array([text["held"]] * n), "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.bincount(owner, seen[tokens], n).astype(np.int64)), "log_counts": pa.array(np.bincount(owner, logs[tokens], n)),
            "bits": pa.array(trusted(book.rest[book.start[tokens] + tokens], costs, sizes)), "n_bytes": pa.array(text["n_bytes"], pa.int64()),
            "rare": pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pairs),
        }
        whole = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        for low in range(0, n, 1024):
            yield whole.slice(low, 1024)

    def score_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, replies = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("to")[i].as_py() >= 0:
                    replies.append(batch.column("answer")[i].as_py())
                    continue
                if text:
                    yield from scored(text, replies)
                text, replies = batch.slice(i, 1).to_pylist()[0], []
        if text:
            yield from scored(text, replies)

    # a block's texts come before its answers, and those by range
    both = table.withColumn("to", F.lit(-1)).unionByName(replied, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "to")
    return both.mapInArrow(score_blocks, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, log_counts double, bits double, n_bytes long, rare array<struct<token:binary,n:long>>")


def score(docs: DataFrame, words: int = 1 << 18, longest: int = 64, rounds: int = 1, block: int = BLOCK) -> DataFrame:
    """Scores ``text`` of every row, learning from rows whose crc32(doc_id) mod 7 is not 2.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    add-one unigram model's log10 probability), score (the mixer's) and
    bits_per_byte (its bits over the bytes of the text, or over 1 for an empty
    one). ``words`` bounds the words with a path; their contexts and all other
    words are counted without a bound. The score depends on the table alone and
    not on how its rows are dealt. Null texts count as empty and have the end
    alone; a null doc_id is held out or not as the empty id is; repeated rows give
    repeated rows; other columns are not read; an empty table gives no rows. With
    no row to learn from every token is unknown.
    """
    raw = docs.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), text_or_empty().cast("binary").alias("raw"))
    counts = cut(token_counts(raw.drop("doc_id")), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    book = codebook(counts, total, words, longest)
    n_ranges = max(1, min(1 << 20, -(-total // RANGE)))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(book)  # bounded by the codebook's words
    table = blocks(raw, sent, block)
    heads = context.broadcast(after_frequent(table, sent))  # bounded by the frequent words
    scored = _score_rows(table, answered(asked(table, sent, n_ranges), sent, heads, rounds, n_ranges), sent, n_ranges)
    rows = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words without a path are spelled once each and looked up one by one
    def without_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.invert(pc.is_in(batch.column("token"), value_set=sent.value.known)))

    rare = cut(counts.mapInArrow(without_path, "token binary, c long"), "rare")
    spelt = spelled(rare, spelling(rare, book))
    each = rows.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.n").join(spelt, "token")
    looked_up = each.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_log"), F.sum(F.col("n") * F.col("spelled")).alias("more_bits")
    )
    bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    return rows.join(looked_up, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.coalesce("more_log", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (bits * math.log10(2)).alias("score"),
        (-bits / F.greatest(F.lit(1), F.col("n_bytes"))).alias("bits_per_byte"),
    )
