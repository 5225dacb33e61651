r"""Language-model scores by online logistic context mixing.

A token (a word [^\x20\x09-\x0D]+ with A-Z lower-cased, or the end of a text) is coded in two steps. Its class (one
of the `FREQUENT` commonest words, or one of `SUFFIXES` buckets of endings) is sent as the bits of a Huffman
code; the word within its class has the Witten-Bell probability of its count. In `score` all unseen words of a
class are one event, as in the base score they are one; `spelled_score` also spells them by an order-1
model of bytes, and so do the bits per byte. Only the class bits need context, so a token costs about six decisions, where bytes would
take fifty.

Each bit is predicted by five predictors. Four have counts of zeros and ones from the training texts: the code's
node alone, and the node hashed with the last class, the last two classes, and the last word. The fifth is indirect: the class
that most often followed the last two words (hashed), if it did so twice at least and half of the times, says the bits of
its own code as long as these come true. So passages that the corpus repeats cost little. The stretched
predictions are mixed with weights that a gate selects (depth in the code, confidence of the pair of
classes, whether the fifth says something and has been right of late); a last stage refines the mix by what has come true in the text so far.
All of this learns online: each text starts from what training has left, and after each bit its counts, its weights and
its last stage move; the fifth predictor follows the text's own words once they come again. Python makes classes and
hashes of the tokens; the bits of each text follow each other in the JVM (ClassBits.java). `online_bits` is the same in numpy, one bit of
many texts at once; no query uses it, tests hold both against plain loops. Probabilities sum to one, over the
words and unseen events or over all spelled texts, and bits_per_byte = -spelled_score log2(10) / bytes.

What is gathered grows with the corpus: counts of all words, and of all hashed contexts. The last word's contexts
have `SLOTS_A_WORD` slots for each distinct training word, at least `1 << LEAST_BITS`; those of two classes as many,
up to about the number of all there can be; the last two words' as many as there are training tokens, up to
`1 << MOST_FOLLOW_BITS`, beyond which more contexts share a slot. Tasks send out the slots they have seen, in chunks; the summed tables
go to the executors as a file that they map, so no process holds them. Of the word counts only the `TOP_WORDS` largest are broadcast, and
other words' counts are joined by shuffle. Words are held as 64-bit hashes.
"""

from __future__ import annotations

import contextlib
import heapq
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import java_code
from .common import free_shuffles, materialize, small_batches, texts_of, trimmed
from .word_hashes import located_words, mixed

FREQUENT, SUFFIXES = 158, 96
CLASSES = 1 + FREQUENT + SUFFIXES  # class 0 is the end of a text
TOP_WORDS = 1 << 20
SLOTS_A_WORD, LEAST_BITS = 4, 20
PAIR_BITS = 24  # 256 x 256 x 255 contexts of two classes and a node
CHUNK = 1 << 14
LEAST_FOLLOW_BITS, MOST_FOLLOW_BITS = 16, 30
#: How sure the fifth predictor is, stretched.
FOLLOWS = np.float32(5.0)
#: By how much the last stage moves.
REFINE_RATE = 0.02
#: Tasks by their number that sum the small tables apart.
SALTS = 16
BLOCK = 32
GATES = 36
#: The most counts of training that a text begins with.
LIMIT = 20.0
#: Bytes of texts that are counted at once.
SLICE = 1 << 18
MOST_BITS = 16
#: Steps of a stretched prediction in the file, one byte each: up to 8 in size.
STEP = 1 / 15
#: Decisions whose slots a task sorts at once.
HELD = 12_000_000
#: Tables of counts: 0 the node; 1 the last class and the node; 2 two classes (hashed); 3 the last word (hashed);
#: 4 pairs of bytes; 5 the classes after two words (hashed). These are small:
SMALL = {0: 256, 1: 256 * 256, 4: 256 * 256}
#: Bytes in lower case, white space as one.
_LOW = np.frombuffer(bytes(0x20 if k in (0x20, *range(0x09, 0x0E)) else k for k in range(256)).lower(), np.uint8)


@dataclass
class Tokens:
    """Of a slice of texts, one text after another, each with its end: hash (0 for an end), class, place in the
    text, text number; for words also first and last byte, in `octets`."""

    word: np.ndarray
    suffix: np.ndarray
    text: np.ndarray
    place: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    octets: np.ndarray
    n: np.ndarray


def tokens_of(texts: list[bytes]) -> Tokens:
    word, counts, octets, starts, ends = located_words(texts)
    last = octets[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, octets[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    suffix = (last * 31 + before * 7) % SUFFIXES
    n = counts + 1
    stops = np.cumsum(n) - 1
    total = int(n.sum())
    is_word = np.ones(total, bool)
    is_word[stops] = False
    spread = lambda x, fill, kind: _spread(x, is_word, fill, kind)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(total) - np.repeat(stops + 1 - n, n)
    return Tokens(spread(np.maximum(word, 1), 0, np.uint64), spread(suffix, -1, np.int64), text, place, spread(starts, 0, np.int64), spread(ends, 0, np.int64), octets, n)


def _spread(x: np.ndarray, where: np.ndarray, fill: int, kind: type) -> np.ndarray:
    out = np.full(len(where), fill, kind)
    out[where] = x
    return out


def _slices(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    held, length, at = [], 0, 0
    for k, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass"))
        length += len(held[-1]) + 1
        if length >= size:
            yield at, held
            held, length, at = [], 0, k + 1
    if held:
        yield at, held


class Lookup:
    """Values of sorted 64-bit keys that are spread evenly: a start by the leading bits, then a few steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        out = np.full(len(keys), missing, self.values.dtype)
        if not len(self.keys):
            return out
        at = self.first[(keys >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            here = np.minimum(at[todo], len(self.keys) - 1)
            k = self.keys[here]
            hit = k == keys[todo]
            out[todo[hit]] = self.values[here[hit]]
            todo = todo[(k < keys[todo]) & (at[todo] < len(self.keys) - 1)]
            at[todo] += 1
        return out


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, bits, lengths) of each symbol's code; nodes are numbered 1.. from the root."""
    w = np.maximum(weights.astype(float), weights.sum() / 2.0 ** (MOST_BITS - 4) + 1e-9)  # so codes stay short
    heap = [(float(x), i, i) for i, x in enumerate(w)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    made = len(w)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[made] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], made, made))
        made += 1
    nodes = np.zeros((len(w), MOST_BITS * 2), np.int64)
    bits, lengths = np.zeros_like(nodes), np.zeros(len(w), np.int64)
    todo, number = [(heap[0][2], [])], 0
    while todo:
        at, path = todo.pop()
        if at < len(w):
            lengths[at] = len(path)
            for k, (n, b) in enumerate(path):
                nodes[at, k], bits[at, k] = n, b
        else:
            number += 1
            todo += [(c, [*path, (number, b)]) for b, c in enumerate(children[at])]
    return nodes[:, : lengths.max()], bits[:, : lengths.max()], lengths


@dataclass
class Code:
    frequent: Lookup  # word -> class
    nodes: np.ndarray
    bits: np.ndarray
    lengths: np.ndarray
    pair_bits: int = LEAST_BITS  # of the number of slots
    word_bits: int = LEAST_BITS
    follow_bits: int = LEAST_FOLLOW_BITS

    def classes(self, t: Tokens) -> np.ndarray:
        known = self.frequent.get(t.word, 0)
        return np.where(t.suffix < 0, 0, np.where(known > 0, known, 1 + FREQUENT + t.suffix))


@dataclass
class Decisions:
    token: np.ndarray
    bit: np.ndarray
    depth: np.ndarray
    slots: tuple[np.ndarray, ...]


def _before(t: Tokens, x: np.ndarray, k: int) -> np.ndarray:
    """Of each token what x is k tokens earlier in its text, else 0."""
    return np.where(t.place >= k, np.concatenate([np.zeros(k, x.dtype), x[:-k]]) if len(x) >= k else np.zeros_like(x), 0)


def two_words(t: Tokens, bits: int) -> np.ndarray:
    """The slot of each token's last two words."""
    one, two = _before(t, t.word, 1), _before(t, t.word, 2)
    return (mixed(one * np.uint64(0x9E3779B97F4A7C15) ^ mixed(two + np.uint64(0x632BE59BD9B4E019))) >> np.uint64(64 - bits)).astype(np.int64)


def decisions(t: Tokens, cls: np.ndarray, code: Code, order: np.ndarray | None = None) -> Decisions:
    """All bits of the tokens, in this order of the tokens."""
    one, two, word = _before(t, cls + 1, 1), _before(t, cls + 1, 2), _before(t, t.word, 1)
    pair = mixed((one * 1024 + two).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    single = mixed(word ^ np.uint64(0x5851F42D4C957F2D))
    order = np.arange(len(cls)) if order is None else order
    n = code.lengths[cls[order]]
    token = np.repeat(order, n)
    depth = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    at = cls[token] * code.nodes.shape[1] + depth
    node, bit = code.nodes.ravel().take(at), code.bits.ravel().take(at)
    step = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def hashed(x: np.ndarray, bits: int) -> np.ndarray:
        slot = x.take(token)
        slot += step
        slot *= np.uint64(0x9FB21C651E98DF25)
        slot >>= np.uint64(64 - bits)
        return slot.view(np.int64)

    slots = (node, (one % 256 * 256).take(token) + node, hashed(pair, code.pair_bits), hashed(single, code.word_bits))
    return Decisions(token, bit, depth, slots)


@dataclass
class Model:
    code: Code
    counts: Lookup  # the top words' counts
    n: int  # training tokens
    v: int  # distinct ones
    log_all: np.ndarray  # of each class: log10(tokens + types)
    log_new: np.ndarray  # of each class: log10(types + 1)
    spell: np.ndarray  # 256 x 256: log10 P(byte | byte before)
    stretch: tuple[np.ndarray, ...]  # of the small tables; where the file is mapped, of all
    file: str  # of tables 2 and 3, and of `sure`
    begin: tuple[np.ndarray, ...] = ()  # of the small tables: zeros and ones that texts begin with
    sure: np.ndarray | None = None  # 0..2, four a byte: how often the slot of two classes was seen
    sure_word: np.ndarray | None = None  # likewise of the last word's
    follow: np.ndarray | None = None  # one more than the class that follows two words, 0 for none
    rate: float = 0.05
    start: tuple[float, ...] = (0.15, 0.3, 0.35, 0.35, 0.8)

    def mapped(self) -> Model:
        """With the tables of the file, wherever Spark has put it."""
        pairs, words, path = 1 << self.code.pair_bits, 1 << self.code.word_bits, SparkFiles.get(self.file)
        of = lambda kind, at, n: np.memmap(path, kind, "r", at, (n,))
        at = pairs + words
        sure, sure_word, follow = of("u1", at, pairs // 4), of("u1", at + pairs // 4, words // 4), of("u1", at + at // 4, 1 << self.code.follow_bits)
        return replace(self, stretch=(*self.stretch[:2], of("i1", 0, pairs), of("i1", pairs, words)), sure=sure, sure_word=sure_word, follow=follow)


def sure_of(m: Model, slots: np.ndarray) -> np.ndarray:
    return _two_bits(m.sure, slots)


def _two_bits(held: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return held[slots >> 2] >> (2 * (slots & 3)).astype(np.uint8) & 3


def trusted(t: Tokens, right: np.ndarray) -> np.ndarray:
    """Of each token 0, 1 or 2: the fifth predictor was wrong about the one before, right, or right about the last four."""
    at = np.arange(len(right))
    wrong = np.where(right, -1, at)
    last = np.maximum.accumulate(np.concatenate([[-1], wrong]))[:-1]  # the last wrong one before
    run = np.minimum(at - 1 - last, t.place)
    return (run > 0).astype(np.int64) + (run > 3)


def class_bits(m: Model, t: Tokens, cls: np.ndarray) -> np.ndarray:
    """log10 P of each text's classes by a plainer mix: counts as in training, weights that move once a block of tokens. No
    query uses it; `online_bits` is the method, and this is what tests compare."""
    order = np.argsort(t.place // BLOCK, kind="stable")
    d = decisions(t, cls, m.code, order)
    of = m.follow[two_words(t, m.code.follow_bits)].astype(np.int64) - 1
    follows, trust = of[d.token], trusted(t, of == cls)[d.token]
    says = (follows >= 0) & (m.code.nodes[follows, d.depth] == d.slots[0])  # its code has come true so far
    said = np.where(says, FOLLOWS * (2 * m.code.bits[follows, d.depth] - 1).astype(np.float32), np.float32(0))
    x = np.stack([*(s[k] * np.float32(1 if s.dtype == np.float32 else STEP) for s, k in zip(m.stretch, d.slots, strict=True)), said], axis=1)
    gates = 36
    texts = len(t.n)
    longest = np.argsort(-t.n, kind="stable")  # texts by falling length: those that later blocks are of come first
    rank = np.empty(texts, np.int64)
    rank[longest] = np.arange(texts)
    text = rank[t.text[d.token]]
    gate = text * gates + np.minimum(d.depth // 2, 2) * 12 + sure_of(m, d.slots[2]) * 4 + says * (1 + trust)
    weights = np.tile(np.array(m.start, np.float32), (texts * gates, 1))
    refine = np.zeros(texts * 8, np.float32)
    total = np.zeros(texts)
    block = (t.place // BLOCK)[d.token]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, int)
    sign = (2 * d.bit - 1).astype(np.float32)

    def add(to: np.ndarray, at: np.ndarray, what: np.ndarray, factor: float) -> None:
        sums = np.bincount(at, what)
        to[: len(sums)] += (factor * sums).astype(to.dtype)

    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        g, xs, y = gate[a:b], x[a:b], d.bit[a:b]
        s = np.einsum("ij,ij->i", xs, weights[g])
        np.clip(s, -12, 12, out=s)
        at = text[a:b] * 8 + np.clip((s + 4).astype(np.int64), 0, 7)
        r = np.clip(s + refine[at], -12, 12)
        p, q = 1 / (1 + np.exp(-s * sign[a:b])), 1 / (1 + np.exp(-r * sign[a:b]))
        add(total, text[a:b], np.log10((p + q) / 2), 1.0)
        wrong = (np.where(y == 1, 1 - p, p - 1)).astype(np.float32)
        for k in range(x.shape[1]):
            add(weights[:, k], g, wrong * xs[:, k], m.rate)
        add(refine, at, np.where(y == 1, 1 - q, q - 1), 0.02)
    return total[rank]


def _stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -8, 8)


def _limited(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts as complex numbers, zeros + ones i, of LIMIT at most, so that a text's own bits still move them."""
    factor = np.minimum(1.0, LIMIT / (zeros + ones))
    return (zeros * factor + 1j * (ones * factor)).astype(np.complex64)


def _begins() -> np.ndarray:
    """Counts by how sure a slot is * 256 + its stretched byte: what was counted up to 3, about as much beyond."""
    odds = np.exp(np.arange(256, dtype=np.uint8).view(np.int8) * STEP)
    out = []
    for least, n in enumerate((0.8, 10.0, 100.0)):
        n = np.maximum(n, 0.4 * (1 + np.maximum(odds, 1 / odds)))  # the rarer bit counts 0.4 at least
        out.append(_limited(n / (1 + odds), n * odds / (1 + odds)))
        if not least:
            for zeros in range(4):
                for ones in range(4 - zeros):
                    if zeros != ones:
                        out[0][int(np.rint(_stretched(np.float64(zeros), np.float64(ones)) / STEP)) % 256] = zeros + 0.4 + 1j * (ones + 0.4)
    return np.concatenate(out)


_BEGINS = _begins()


def followers(m: Model, t: Tokens, cls: np.ndarray) -> np.ndarray:
    """The class that should follow each token's last two words, -1 for none: as last in this text, else as in training."""
    slot = two_words(t, m.code.follow_bits)
    of = m.follow[slot].astype(np.int64) - 1
    order = np.lexsort((slot, t.text))  # stable: each text's tokens of a slot in turn
    again = np.flatnonzero((np.diff(slot[order]) == 0) & (np.diff(t.text[order]) == 0)) + 1
    of[order[again]] = cls[order[again - 1]]
    return of


@dataclass
class Prepared:
    """The decisions of a slice's texts: how many each text has; of each one the cells of its four counts, gate, bit and what the fifth predictor says."""

    n: np.ndarray
    cell: np.ndarray
    gate: np.ndarray
    bit: np.ndarray
    said: np.ndarray
    counts: np.ndarray  # that cells begin with


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where equal keys lie, one key after another; the keys' numbers there; where each key first lies."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits > 64:
        key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    packed = key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    at = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    packed >>= np.uint64(bits)
    new = np.ones(len(key), bool)
    new[1:] = packed[1:] != packed[:-1]
    return at, np.cumsum(new, dtype=np.int32) - np.int32(1), at[new]


def prepared(m: Model, t: Tokens, cls: np.ndarray) -> Prepared:
    d, texts = decisions(t, cls, m.code), len(t.n)
    of = followers(m, t, cls)
    trust = trusted(t, of == cls).astype(np.int8)
    follows = of[d.token]
    says = (follows >= 0) & (m.code.nodes[follows, d.depth] == d.slots[0])  # its code has come true so far
    said = says * (2 * m.code.bits[follows, d.depth] - 1).astype(np.int8)
    gate = (np.minimum(d.depth // 2, 2) * 12 + sure_of(m, d.slots[2]) * 4 + says * (1 + trust[d.token])).astype(np.int8)
    del follows, says
    one, two = _before(t, cls + 1, 1), _before(t, cls + 1, 2)
    words, word = np.unique(_before(t, t.word, 1), return_inverse=True)
    cell, held, size = np.empty((4, len(d.bit)), np.int32), [], 0
    for k, context in enumerate((t.text, t.text * 257 + one, (t.text * 257 + one) * 257 + two, t.text * len(words) + word)):
        at, number, first = _numbered((context[d.token] * 256 + d.slots[0]).astype(np.uint64))
        cell[k, at] = number + np.int32(size)
        size += len(first)
        slots = d.slots[k][first]
        held.append(m.begin[k][slots] if k < 2 else _BEGINS[_two_bits(m.sure if k == 2 else m.sure_word, slots).astype(np.int64) * 256 + m.stretch[k][slots].view(np.uint8)])
    return Prepared(np.bincount(t.text, m.code.lengths[cls], texts).astype(np.int64), cell, gate, d.bit.astype(np.int8), said, np.concatenate(held))


def online_bits(m: Model, parts: list[Prepared]) -> np.ndarray:
    """log10 P of each text's classes. Its counts, weights and last stage start alike for each text, from training, and move after each
    bit. All texts go in step, each by its next bit at once; a text's score depends on no other."""
    n = np.concatenate([x.n for x in parts])
    texts, total = len(n), int(n.sum())
    longest = np.argsort(-n, kind="stable")
    rank = np.empty(texts, np.int64)
    rank[longest] = np.arange(texts)
    bounds = np.concatenate([[0], np.cumsum(texts - np.searchsorted(np.sort(n), np.arange(n.max(initial=0)), "right"))])
    cell, gate, y, said = np.empty((4, total), np.int32), np.empty(total, np.int32), np.empty(total, np.int8), np.empty(total, np.int8)
    counts = np.concatenate([x.counts for x in parts])
    done = size = 0
    for part in parts:
        at = _in_step(bounds, part.n, rank[done : done + len(part.n)])
        for k in range(4):
            cell[k, at] = part.cell[k] + np.int32(size)
        gate[at] = part.gate + np.repeat(rank[done : done + len(part.n)].astype(np.int32) * GATES, part.n)
        y[at], said[at] = part.bit, part.said
        done, size = done + len(part.n), size + len(part.counts)
        part.cell = part.gate = part.bit = part.said = part.counts = None
    weights, refine = np.tile(np.array(m.start, np.float32), (texts * GATES, 1)), np.zeros(texts * 8, np.float32)
    buckets = np.arange(texts) * 8 + 4
    chance = np.empty(total, np.float32)
    inputs, sums = np.empty((5, texts), np.float32), np.empty((2, texts), np.float32)
    seen, signs, rates = np.array([1, 1j], np.complex64), np.array([-1, 1], np.float32), np.array([[m.rate], [REFINE_RATE]], np.float32)
    one, twelve = np.float32(1), np.float32(12)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        w, c, g, bit = b - a, cell[:, a:b], gate[a:b], y[a:b]
        now, x, z, sign = counts.take(c), inputs[:, :w], sums[:, :w], signs.take(bit)
        np.log(now.imag / now.real, out=x[:4])
        np.multiply(said[a:b], FOLLOWS, out=x[4])
        mix = weights.take(g, 0)
        s = np.einsum("ji,ij->i", x, mix, out=z[0])
        last = np.minimum(np.maximum(s, -4), 3)
        last = buckets[:w] + np.floor(last, out=last).astype(np.int64)
        shift = refine.take(last)
        np.add(np.minimum(np.maximum(s, -twelve, out=s), twelve, out=s), shift, out=z[1])
        p = one / (one + np.exp(np.minimum(np.maximum(z, -twelve), twelve) * -sign))
        np.add(p[0], p[1], out=chance[a:b])
        move = (one - p) * (sign * rates)
        x *= move[0]
        mix += x.T
        weights[g] = mix
        shift += move[1]
        refine[last] = shift
        now += seen.take(bit)
        counts[c] = now
    np.log10(np.multiply(chance, np.float32(0.5), out=chance), out=chance)
    sums = np.zeros(texts)
    done = 0
    for part in parts:
        k = len(part.n)
        at = _in_step(bounds, part.n, rank[done : done + k])
        sums[done : done + k] = np.bincount(np.repeat(np.arange(k), part.n), chance[at], k)
        done += k
    return sums


def _in_step(bounds: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the bits of texts with these ranks where all texts' first bits come first, then the second ones, ..."""
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return bounds[at] + np.repeat(rank, n)


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % 7 == 2 for x in doc_ids], bool)


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2).select("text")


def _word_counts(training: DataFrame) -> DataFrame:
    """(word, suffix, c); the end of a text is word 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            word, suffix, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, back = np.unique(word, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(suffix[first], pa.int32()), pa.array(np.bincount(back, c).astype(np.int64))], ["word", "suffix", "c"])

        for b in batches:
            for _, part in _slices(texts_of(b)):
                t = tokens_of(part)
                u, first, c = np.unique(t.word, return_index=True, return_counts=True)
                held.append((u, t.suffix[first], c))
                size += len(u)
                if size > 1_500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = training.mapInArrow(trimmed(run), "word long, suffix int, c long")
    return materialize(counts.groupBy("word").agg(F.max("suffix").alias("suffix"), F.sum("c").alias("c")), "words")


def _steps(at: np.ndarray, size: int) -> bytes:
    """The steps of ascending numbers of `size` bytes, all first bytes, then all second ones, ...: the last ones compress."""
    return np.diff(at, prepend=at.dtype.type(0)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].T.tobytes()


def _read_steps(octets: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(octets, np.uint8).reshape(size, -1)
    return np.cumsum(sum(p.astype(np.int64) << 8 * k for k, p in enumerate(planes)))


def _chunks(table: int, keys: np.ndarray, counts: np.ndarray, salt: int = 0) -> pa.RecordBatch:
    """Rows of counts by ascending slot * 2 + bit: a byte each, and those of 255 and more in `more`."""
    chunk = keys // (2 * CHUNK)
    first = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1]) if len(keys) else np.zeros(0, np.int64)
    bounds = np.concatenate([first, [len(keys)]])
    large = counts >= 255
    before = np.concatenate([[0], np.cumsum(large)])

    def cells(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])

    columns = [pa.array(np.full(len(first), table, np.int32)), pa.array(chunk[first].astype(np.int64)), pa.array(np.full(len(first), salt, np.int32)), pa.array([_steps(keys[a:b] % (2 * CHUNK), 2) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), cells(np.minimum(counts, 255).astype("u1"), bounds), cells(counts[large].astype("<i8"), before[bounds])]
    return pa.RecordBatch.from_arrays(columns, ["table", "chunk", "salt", "at", "counts", "more"])


def _followers(number: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of counts by ascending slot * 256 + class, 65,536 slots a chunk."""
    chunk = keys >> np.uint64(24)
    first = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(keys)]])
    at = [_steps(keys[a:b] & np.uint64(0xFFFFFF), 3) for a, b in zip(first[:-1], first[1:], strict=True)]
    held = np.minimum(counts, 255).astype("u1")
    n = len(at)
    columns = [pa.array(np.full(n, 5, np.int32)), pa.array(chunk[first[:-1]].astype(np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(at, pa.binary()), pa.array([held[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([b""] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["table", "chunk", "salt", "at", "counts", "more"])


def _flushed(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The counts of the keys held of each table, which are given up; little more than a table's keys is held beside them."""
    for table, parts in held.items():
        keys = np.concatenate(parts)
        parts.clear()
        keys.sort()
        at = 0
        while at < len(keys):  # about a million keys at once; the next batch may go on with a chunk
            some = keys[at : np.searchsorted(keys, keys[min(at + (1 << 20), len(keys)) - 1], "right")]
            at += len(some)
            first = np.concatenate([[0], np.flatnonzero(some[1:] != some[:-1]) + 1])
            part, n = some[first], np.diff(first, append=len(some))
            yield _followers(table, part, n) if table == 5 else _chunks(table, part.astype(np.int64), n)


def _likeliest(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Of each slot of a chunk one more than its likeliest class, if seen twice at least and half of the times, else 0."""
    keys = np.concatenate([_read_steps(at, 3) for at, _ in parts])
    known, back = np.unique(keys, return_inverse=True)
    counts = np.bincount(back, np.concatenate([np.frombuffer(c, "u1") for _, c in parts])).astype(np.int64)
    slot, cls = known >> 8, known & 255
    total = np.bincount(slot, counts, 1 << 16)
    best = np.lexsort((-cls, counts))  # the last one of a slot stays: the most, then the lower class
    out, most = np.zeros(1 << 16, "u1"), np.zeros(1 << 16, np.int64)
    out[slot[best]], most[slot[best]] = cls[best] + 1, counts[best]
    out[(most < 2) | (2 * most < total)] = 0
    return out


def _context_counts(training: DataFrame, code: Code) -> tuple[dict[int, np.ndarray], str]:
    """Zeros and ones of every slot of the small tables (pairs of bytes in ones); the file of the others."""
    sc = training.sparkSession.sparkContext
    shared = sc.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        small = {k: np.zeros(2 * n, np.int64) for k, n in SMALL.items()}
        held: dict[int, list[np.ndarray]] = {2: [], 3: [], 5: []}
        size = 0

        for b in batches:
            for _, part in _slices(texts_of(b), SLICE):
                t = tokens_of(part)
                cls = c.classes(t)
                d = decisions(t, cls, c)
                for table in (0, 1):
                    small[table] += np.bincount(d.slots[table] * 2 + d.bit, minlength=len(small[table]))
                for table, bits in ((2, c.pair_bits), (3, c.word_bits)):
                    held[table].append((d.slots[table] * 2 + d.bit).astype(np.uint32 if bits < 32 else np.uint64))
                held[5].append(two_words(t, c.follow_bits).astype(np.uint64) << np.uint64(8) | cls.astype(np.uint64))
                small[4][1::2] += _byte_pairs(t)
                size += len(d.bit)
                if size >= HELD:
                    yield from _flushed(held)
                    size = 0
        if size:
            yield from _flushed(held)
        for table, counts in small.items():
            keys = np.flatnonzero(counts)
            yield _chunks(table, keys, counts[keys], TaskContext.get().partitionId() % SALTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, follow = None, np.zeros(2 * CHUNK, np.int64), []

        def row() -> pa.RecordBatch:
            zeros, ones = sums[0::2], sums[1::2]
            if now[0] in SMALL:
                values, sure = sums.tobytes(), b""
            elif now[0] == 5:
                values, sure = _likeliest(follow).tobytes(), b""
            else:
                values, seen = np.rint(_stretched(zeros, ones) / STEP).astype("i1").tobytes(), zeros + ones
                four = ((seen > 3).astype("u1") + (seen > 60)).astype("u1").reshape(-1, 4)
                sure = (four << np.arange(0, 8, 2, dtype="u1")).sum(1, dtype="u1").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([values], pa.binary()), pa.array([sure], pa.binary())], ["table", "chunk", "vals", "sure"])

        for b in batches:
            for table, chunk, salt, at, counts, more in zip(*(b.column(c).to_pylist() for c in ("table", "chunk", "salt", "at", "counts", "more")), strict=True):
                if (table, chunk, salt) != now:
                    if now is not None:
                        yield row()
                    now, sums, follow = (table, chunk, salt), np.zeros(2 * CHUNK, np.int64), []
                if table == 5:
                    follow.append((at, counts))
                    continue
                n = np.frombuffer(counts, "u1").astype(np.int64)
                if more:
                    n[n == 255] = np.frombuffer(more, "<i8")
                sums[_read_steps(at, 2)] += n
        if now is not None:
            yield row()

    parts = training.mapInArrow(trimmed(run), "table int, chunk long, salt int, at binary, counts binary, more binary")
    summed = parts.repartition("table", "chunk", "salt").sortWithinPartitions("table", "chunk", "salt").mapInArrow(trimmed(add), "table int, chunk long, vals binary, sure binary")
    out = {k: np.zeros(-(-2 * n // (2 * CHUNK)) * 2 * CHUNK, np.int64) for k, n in SMALL.items()}
    pairs, words = 1 << code.pair_bits, 1 << code.word_bits
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"contexts-{uuid.uuid4().hex}")
    with open(path, "wb") as f:
        f.truncate(pairs + words + (pairs + words) // 4 + (1 << code.follow_bits))  # zeros: slots never seen
        for r in summed.toLocalIterator():
            table, chunk = r["table"], r["chunk"]
            if table in SMALL:
                out[table][chunk * 2 * CHUNK : (chunk + 1) * 2 * CHUNK] += np.frombuffer(r["vals"], np.int64)
            elif table == 5:
                f.seek(pairs + words + (pairs + words) // 4 + (chunk << 16))
                f.write(r["vals"])
            else:
                at = (0 if table == 2 else pairs) + chunk * CHUNK
                f.seek(at)
                f.write(r["vals"])
                f.seek(pairs + words + at // 4)
                f.write(r["sure"])
    sc.addFile(path)
    with contextlib.suppress(OSError):  # the driver's own copy
        os.link(path, f"{path}-link")
        os.replace(f"{path}-link", SparkFiles.get(os.path.basename(path)))
    return {k: v[: 2 * SMALL[k]] for k, v in out.items()}, path


def _byte_pairs(t: Tokens) -> np.ndarray:
    """How often each byte before * 256 + byte of the words' bytes comes, from white space to white space."""
    octets = _LOW[t.octets].astype(np.uint16)
    pairs = octets.copy()
    pairs[1:] |= octets[:-1] << np.uint16(8)
    pairs[:1] |= 0x2000
    counts = np.bincount(pairs, minlength=SMALL[4])
    counts[0x2020] = 0
    return counts


def fit(docs: DataFrame) -> tuple[Model, DataFrame, str]:
    """The model, the table of all training words' counts, and the driver's file of contexts."""
    training = _training(docs)
    words = _word_counts(training)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = words.orderBy(F.desc("c"), "word").limit(TOP_WORDS).toArrow()
    keys, c = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy()
    frequent = keys[keys != 0][:FREQUENT]
    number = Lookup(frequent, np.arange(1, len(frequent) + 1))
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    is_frequent = F.col("word").isin([int(x) for x in frequent.view(np.int64)])
    for r in words.where(~is_frequent).groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("t")).collect():
        k = 0 if r["suffix"] < 0 else 1 + FREQUENT + r["suffix"]
        tokens[k], types[k] = r["c"], r["t"]
    tokens[1 : len(frequent) + 1] = c[keys != 0][:FREQUENT]
    bits = max(LEAST_BITS, (SLOTS_A_WORD * int(total["v"])).bit_length())
    follow_bits = min(max(LEAST_FOLLOW_BITS, int(total["n"]).bit_length() - 1), MOST_FOLLOW_BITS)
    code = Code(number, *huffman(tokens + 0.5), min(bits, PAIR_BITS), bits, follow_bits)
    free_shuffles(docs.sparkSession)
    counts, path = _context_counts(training, code)
    stretch = tuple(_stretched(counts[k][0::2], counts[k][1::2]).astype(np.float32) for k in (0, 1))
    begin = tuple(_limited(counts[k][0::2] + 0.4, counts[k][1::2] + 0.4) for k in (0, 1))
    pairs = counts[4][1::2].reshape(256, 256) + 0.05
    spell = np.log10(pairs / pairs.sum(1, keepdims=True))
    alone = (np.arange(CLASSES) >= 0) & (np.arange(CLASSES) <= FREQUENT)  # one word each, nothing new
    log_all = np.where(alone, 0.0, np.log10(tokens + types + 1))
    log_new = np.where(alone, 0.0, np.log10(types + 1))
    c = c.astype(np.int32) if len(c) and c.max() < 1 << 31 else c
    return Model(code, Lookup(keys, c), int(total["n"]), int(total["v"]), log_all, log_new, spell, stretch, os.path.basename(path), begin), words, path


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    spelled_score, bits_per_byte) of each row of
    docs(doc_id, text, ...), learning from the rows whose crc32(doc_id as text) mod 7 is not 2.

    Null and empty texts are their end alone; a null doc_id stays null and counts as an empty text of an id
    (it trains); repeated rows count each; other columns are ignored; an empty table gives an empty one. A text
    of 2^28 tokens or more is refused.
    """
    small_batches(docs.sparkSession)
    model, words, path = fit(docs)
    free_shuffles(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, texts in _slices(texts_of(batch), SLICE):
                t = tokens_of(texts)
                b, texts_n = a + len(texts), len(texts)
                cls = m.code.classes(t)
                c = m.counts.get(t.word, -1)
                known = c >= 0
                per = lambda v, where: np.bincount(t.text[where], v[where], texts_n)  # noqa: E731, B023
                base = per(np.log10(np.maximum(c, 0) + 1.0), known)
                inner = np.where((cls > 0) & (cls <= FREQUENT), 0.0, np.log10(np.maximum(c, 1)) - m.log_all[cls])
                inner[t.suffix < 0] = 0.0
                rare = np.flatnonzero(~known & (t.suffix >= 0))
                miss = m.log_new[cls[rare]] - m.log_all[cls[rare]]
                ends = np.searchsorted(t.text[rare], np.arange(texts_n + 1))
                values = [t.word[rare].view(np.int64), m.log_all[cls[rare]], miss, _spelled(m.spell, t, rare)]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in values]
                n_known = per(np.ones(len(c)), known & (c > 0)).astype(np.int64)
                columns = [pa.array(number + np.arange(a, b)), pa.array(ids[a:b], pa.int64()), pa.array(held_out(ids[a:b])), pa.array(t.n, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(n_known), pa.array(base), pa.array(per(inner, known))]
                coded = [_by_text(cls.astype("u1"), t.n), _by_text(t.word.astype("<u8"), t.n)]
                yield pa.RecordBatch.from_arrays([*columns, *lists, *coded], ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "inside", "words", "hit", "miss", "spelled", "classes", "hashes"])
            number += len(ids)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, inside double, words array<long>, hit array<double>, miss array<double>, spelled array<double>, classes binary, hashes binary"
    coded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), schema)
    scored = materialize(coded.withColumn("score", coded_bits(docs.sparkSession, model) + F.col("inside")).drop("inside", "classes", "hashes"), "scored")
    shared.unpersist()
    for held in (path, SparkFiles.get(model.file)):  # executors that come later still ask for the file
        open(held, "wb").close()
    rare = scored.select("row", F.explode(F.arrays_zip("words", "hit", "miss", "spelled")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.hit").alias("hit"), F.col("x.miss").alias("miss"), F.col("x.spelled").alias("spelled"))
    found = rare.join(words.select("word", "c"), "word", "left")
    has = F.col("c").isNotNull()
    more = found.groupBy("row").agg(
        F.sum(has.cast("long")).alias("more_known"),
        F.sum(F.when(has, F.log10(F.col("c") + 1)).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(has, F.log10("c") - F.col("hit")).otherwise(F.col("miss"))).alias("more_score"),
        F.sum(F.when(has, 0.0).otherwise(F.col("spelled"))).alias("spelled"),
    )
    all_ = scored.drop("words", "hit", "miss", "spelled").join(more, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    spelled = out + F.coalesce("spelled", F.lit(0.0))
    return all_.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(model.n + model.v + 1))).alias("base_score"),
        out.alias("score"),
        spelled.alias("spelled_score"),
        F.when(F.col("n_bytes") > 0, -spelled * float(np.log2(10.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def coded_bits(spark: SparkSession, m: Model) -> Column:
    """What online_bits gives, from the bytes of a row's `classes` and word `hashes`: ClassBits.java goes through one text after another."""
    return F.call_function(java_code.function(spark, "ClassBits", DoubleType()), "classes", "hashes", F.lit(m.file), F.lit(_tables_file(spark, m)))


def _by_text(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """The bytes of each text's values."""
    ends = np.concatenate([[0], np.cumsum(n)]) * values.itemsize
    if ends[-1] >= 1 << 31:
        raise OverflowError("a text has 2^28 tokens or more")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _tables_file(spark: SparkSession, m: Model) -> str:
    """The name of a file for ClassBits with the code, the rates and the small tables: of each array its length, then its values."""
    code = m.code
    arrays = [
        [code.nodes.shape[1], code.pair_bits, code.word_bits, code.follow_bits, GATES],
        np.array([m.rate, REFINE_RATE, FOLLOWS], np.float32),
        *(x.ravel() for x in (code.lengths, code.nodes, code.bits)),
        np.array(m.start, np.float32),
        *(x.view(np.float32) for x in (*m.begin, _BEGINS)),
    ]
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"code-{uuid.uuid4().hex}")
    with open(path, "wb") as f:
        for x in map(np.asarray, arrays):
            f.write(np.array(len(x), ">i4").tobytes() + x.astype(">f4" if x.dtype == np.float32 else ">i4").tobytes())
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _spelled(spell: np.ndarray, t: Tokens, which: np.ndarray) -> np.ndarray:
    """log10 P of the bytes of these words and the white space after them."""
    n = t.stop[which] + 1 - t.start[which]
    ends = np.cumsum(n)
    at = np.arange(n.sum()) + np.repeat(t.start[which] - (ends - n), n)
    step = spell[np.where(at > 0, _LOW[t.octets[at - 1]], 0x20), _LOW[t.octets[at]]]
    return np.diff(np.concatenate([[0.0], np.cumsum(step)])[np.concatenate([[0], ends])])
