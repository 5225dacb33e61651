r"""Exact n-gram Jaccard join by a prefix tree of globally ordered sets.

Texts are lower-cased (A-Z) and cut into words [^\x20\x09-\x0D]+; a document's set holds its distinct 5-word
shingles, as 63-bit hashes (a text of fewer words is one shingle). All sets are ordered alike, rare shingles
first, so that what only copies have in common comes before what many documents quote.

1. Document frequencies. A chunk of documents sends each of its shingles once, whatever the number of its documents that
   have it, so a passage in every document costs a task one entry a chunk. What comes back are the shared ones and
   the power of two of their frequency. The order is by that power, then by value; it is the same for all
   sets, and no result depends on it.
2. Two sets with J >= t share one of the first |x| - ceil(t |x|) + 1 elements of either (prefix filter), the heads. A
   document of which no head is shared, which is one with less than three quarters in common with others, is done with. Equal
   sets form a class, of which one goes on. Of lists of the same documents one is kept.
3. Star rounds: each document is verified against the least partner that its lists name, and links are joined to
   components. So a large group of near copies costs links in proportion to its size: a pair in one component needs no
   link of its own.
4. Trie join. Of the lists whose documents lie in several components those documents remain that have a partner in another one
   by size and by place: from the first element that two sets share on, either has what they must share. These
   are stored as a trie, which is walked depth first with the partial overlaps of all other documents at each
   node; a branch is left once these and what remains of it can't reach ceil(t (|x| + |y|) / (1 + t)).
   Only pairs that can are found, and of these only a tree that joins the same documents becomes rows; a long list is walked
   by blocks. Should one of the tree's pairs fail, all others that were found are verified too. No pair is left out.
5. What is named by 3 and 4 is verified by whole sets. These, sorted as byte strings, are the depth-first order of their
   trie too; all partners of a set stand together, and each starts from the overlap of the prefix it shares with its predecessor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, discard, is_marked, materialize, materialize_by, small_batches, texts_of, trimmed
from .word_hashes import hashed_words, mixed
from ..operators.components import components

N = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that a chunk holds, and documents (their numbers have two bytes).
CHUNK_KEYS, CHUNK_DOCS = 1 << 20, 60_000
#: About so many entries meet in one part of the hashes, whatever the size of the corpus.
PART_KEYS = 800_000
#: Star rounds before the trie join, and documents of a list that it takes at once.
STARS, BLOCK = 1, 512
#: Places in the order: the power of two of the frequency, over a part's number and 32 bits within the part.
POWER_AT, MOST_POWER = 58, 31


def shingle_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """Of each text the distinct shingles' 63-bit hashes, ascending."""
    for words, counts in hashed_words(texts):
        at = 0
        m = max(len(words) - N + 1, 0)
        s = words[:m].copy()
        for k in range(1, N):
            s *= _MULTIPLIER
            s += words[k : k + m]
            s ^= s >> np.uint64(29)
        s = mixed(s) >> np.uint64(1)
        for n in counts:
            if n >= N:
                yield np.unique(s[at : at + n - N + 1])
            elif n:
                yield np.array([xxhash.xxh64_intdigest(words[at : at + n].tobytes(), seed=int(n)) >> 1], np.uint64)
            else:
                yield np.empty(0, np.uint64)
            at += n


def prefix_length(n, percent: int):
    """Of one set, or of an array of them."""
    return n + (-percent * n // 100) + (n > 0)


def least_overlap(nx: int, ny: int, percent: int) -> int:
    """The least i with 100 i >= percent (nx + ny - i)."""
    return -(-percent * (nx + ny) // (100 + percent))


class TrieWalk:
    """Overlaps of sets, taken in trie order, with one fixed set."""

    def __init__(self, fixed: np.ndarray, percent: int, step: int = 64):
        self.fixed, self.percent, self.step = fixed, percent, step
        self.last, self.depth = np.empty(0, np.uint64), 0
        self.overlap, self.passed = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def linked(self, keys: np.ndarray) -> bool:
        fixed, n = self.fixed, len(keys)
        need = least_overlap(len(fixed), n, self.percent)
        if min(len(fixed), n) < need:
            return False
        shared = min(len(self.last), n)
        differ = np.flatnonzero(self.last[:shared] != keys[:shared])
        depth = min(int(differ[0]) if len(differ) else shared, self.depth)
        overlap, passed = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        overlap[: depth + 1], passed[: depth + 1] = self.overlap[: depth + 1], self.passed[: depth + 1]
        while overlap[depth] + min(n - depth, len(fixed) - passed[depth]) >= need and depth < n:
            part = keys[depth : depth + self.step]
            at = np.searchsorted(fixed, part)
            hit = fixed[np.minimum(at, len(fixed) - 1)] == part
            end = depth + len(part)
            overlap[depth + 1 : end + 1] = overlap[depth] + np.cumsum(hit)
            passed[depth + 1 : end + 1] = at + hit
            depth = end
        self.last, self.depth, self.overlap, self.passed = keys, depth, overlap, passed
        return depth == n and bool(overlap[n] >= need)


def _planes(x: np.ndarray) -> bytes:
    """The steps of ascending four-byte numbers, all first bytes, then all second ones, ...: the first ones compress."""
    return np.diff(x, prepend=np.uint64(0)).astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _read_planes(octets: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(octets, np.uint8).reshape(4, -1).T.copy().view(">u4").reshape(-1), dtype=np.uint64)


class Parts:
    """Equal parts of the hashes. A value is a part's number over 32 bits of the place in it."""

    def __init__(self, n: int):
        self.n, self.width = n, (1 << 63) // n + 1
        self.shift = max(0, self.width.bit_length() - 32)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        part, place = np.divmod(hashes, np.uint64(self.width))
        return part << np.uint64(32) | place >> np.uint64(self.shift)


_CHUNK = "chunk long, part int, keys binary, owners binary, several binary, counts binary, doc_id array<long>, mark array<long>, n array<int>, counted array<int>, digest array<binary>"
_CHUNK_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
_CHUNK_NAMES = [c.split(" ")[0] for c in _CHUNK.split(", ")]


def _rows(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHUNK_TYPES, strict=True)], _CHUNK_NAMES)


def _chunks(docs: DataFrame, n_parts: int) -> DataFrame:
    """Chunks of documents. Part -1: the documents (id, hash of the text, size of the set, number of its values, digest
    of the set), and in keys and owners the values that several of them have. Other parts: the values that one document has and its number, and
    those that several have and by how many, at most 255."""
    parts = Parts(n_parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        held: list[tuple] = []
        values: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            owner = np.repeat(np.arange(len(values), dtype=np.uint16), [len(v) for v in values])
            all_ = np.concatenate(values)
            order = np.argsort(all_, kind="stable")
            all_, owner = all_[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]])) if len(all_) else np.empty(0, np.int64)
            count = np.diff(np.concatenate([first, [len(all_)]]))
            one, more = first[count == 1], first[count > 1]
            many = np.repeat(count, count) > 1
            columns = [[number], [-1], [all_[many].astype("<u8").tobytes()], [owner[many].astype("<u2").tobytes()], [None], [None], *([list(c)] for c in zip(*held, strict=True))]
            yield _rows(columns)
            at_one, at_more = (np.searchsorted(all_[x] >> np.uint64(32), np.arange(n_parts + 1, dtype=np.uint64)) for x in (one, more))
            capped = np.minimum(count[count > 1], 255).astype(np.uint8)
            rows = []
            for p in np.flatnonzero((np.diff(at_one) > 0) | (np.diff(at_more) > 0)):
                x, y = one[at_one[p] : at_one[p + 1]], more[at_more[p] : at_more[p + 1]]
                rows.append((number, int(p), _planes(all_[x] & np.uint64(0xFFFFFFFF)), owner[x].astype("<u2").tobytes(), _planes(all_[y] & np.uint64(0xFFFFFFFF)), capped[at_more[p] : at_more[p + 1]].tobytes(), *(None,) * 5))
            if rows:
                yield _rows([list(c) for c in zip(*rows, strict=True)])

        for b in batches:
            for doc, mark, h in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), shingle_hashes(texts_of(b)), strict=True):
                v = np.unique(parts.values(h))
                held.append((doc, mark, len(h), len(v), xxhash.xxh3_128_digest(h.tobytes())))
                values.append(v)
                size += len(v)
                if size >= CHUNK_KEYS or len(held) >= CHUNK_DOCS:
                    yield from flush()
                    number, held, values, size = number + 1, [], [], 0
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(trimmed(run), _CHUNK)


def _counted(values: DataFrame) -> DataFrame:
    """Of each chunk's parts what is shared: values and owners, and those that several of its documents have; counts
    hold the powers of two of the numbers of documents, first of `keys`, then of `several`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            ones, mores = [_read_planes(x[1]) for x in held], [_read_planes(x[3]) for x in held]
            value = np.concatenate([*ones, *mores])
            count = np.concatenate([np.ones(sum(map(len, ones)), np.int64), *(np.frombuffer(x[4], np.uint8) for x in held)])
            order = np.argsort(value, kind="stable")
            ranked = value[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            total = np.add.reduceat(count[order], first)
            back = np.empty(len(value), np.uint8)
            power = np.minimum(np.ceil(np.log2(total)), MOST_POWER).astype(np.uint8)  # 0: one document alone
            back[order] = np.repeat(power, np.diff(np.concatenate([first, [len(value)]])))
            at, other = 0, sum(map(len, ones))
            rows = []
            for x, o, m in zip(held, ones, mores, strict=True):
                p, q = back[at : at + len(o)], back[other : other + len(m)]
                at, other = at + len(o), other + len(m)
                keep = p > 0
                if keep.any() or len(q):
                    rows.append((x[0], now, _planes(o[keep]), np.frombuffer(x[2], "<u2")[keep].tobytes(), x[3], np.concatenate([p[keep], q]).tobytes(), *(None,) * 5))
            for a in range(0, len(rows), 256):
                yield _rows([list(c) for c in zip(*rows[a : a + 256], strict=True)])

        for b in batches:
            for part, *row in zip(*(b.column(c).to_pylist() for c in ("part", "chunk", "keys", "owners", "several", "counts")), strict=True):
                if held and part != now:
                    yield from flush()
                    held = []
                now = part
                held.append(row)
        if held:
            yield from flush()

    return values.repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(run), _CHUNK)


def _posted(about: DataFrame, values: DataFrame, percent: int) -> DataFrame:
    """(id, doc_id, mark, n, digest, start, lost, posted): the documents that have a shared value among their heads, with
    all their shared values, in the places start, start + 1, ...; lost is by how much they have fewer values than shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, owners, ranks, several = None, [], [], []

        def flush() -> pa.RecordBatch:
            chunk, value, owner, doc_id, mark, n, counted, digest = about
            keys = np.concatenate([x for x, _ in several] or [np.empty(0, np.uint64)])
            power = np.concatenate([x for _, x in several] or [np.empty(0, np.uint64)])
            if len(value):
                ranks.append(power[np.searchsorted(keys, value)] << np.uint64(POWER_AT) | value)
                owners.append(owner)
            rank, own = np.concatenate([*ranks, np.empty(0, np.uint64)]), np.concatenate([*owners, np.empty(0, np.int64)]).astype(np.int64)
            order = np.lexsort((rank, own))
            rank = rank[order]
            n, counted = np.array(n, np.int64), np.array(counted, np.int64)
            shared = np.bincount(own, minlength=len(n))
            begin = np.cumsum(shared) - shared
            start = counted - shared
            out = []
            for k in np.flatnonzero((shared > 0) & (start < prefix_length(n, percent))):
                out.append((chunk << 16 | int(k), doc_id[k], mark[k], int(n[k]), digest[k], int(start[k]), int(n[k] - counted[k]), rank[begin[k] : begin[k] + shared[k]].astype("<i8").tobytes()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 8, types, strict=True)], ["id", "doc_id", "mark", "n", "digest", "start", "lost", "posted"])

        for b in batches:
            for chunk, part, keys, own, more, counts, *documents in zip(*(b.column(c).to_pylist() for c in _CHUNK_NAMES), strict=True):
                if part < 0:
                    if about:
                        yield flush()
                    about, owners, ranks, several = (chunk, np.frombuffer(keys, "<u8"), np.frombuffer(own, "<u2"), *documents), [], [], []
                    continue
                power = np.frombuffer(counts, np.uint8).astype(np.uint64)
                value, lot = (_read_planes(x) | np.uint64(part << 32) for x in (keys, more))
                owners.append(np.frombuffer(own, "<u2"))
                ranks.append(power[: len(value)] << np.uint64(POWER_AT) | value)
                several.append((lot, power[len(value) :]))
        if about:
            yield flush()

    both = about.unionByName(_counted(values))
    return both.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(trimmed(run), "id long, doc_id long, mark long, n int, digest binary, start int, lost int, posted binary")


def _lists(posted: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, place) of the heads that two documents share; of lists of the same documents the one of the least key. A
    pair's first common value is kept, since the lists that come before it lack one of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, start = (b.column(c).to_numpy() for c in ("id", "n", "start"))
            keys = [np.frombuffer(p, np.int64)[:most] for p, most in zip(b.column("posted").to_pylist(), (prefix_length(sizes.astype(np.int64), percent) - start).tolist(), strict=True)]
            n = np.array([len(k) for k in keys])
            for at in range(0, len(ids), 256):  # a long text has thousands of values
                part = slice(at, at + 256)
                ends = np.cumsum(n[part])
                place = np.arange(n[part].sum()) - np.repeat(ends - n[part] - start[part], n[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys[part])), *(pa.array(np.repeat(x[part], n[part])) for x in (ids, sizes)), pa.array(place.astype(np.int32))], ["key", "id", "n", "place"])

    postings = materialize(posted.select("id", "n", "start", "posted").mapInArrow(trimmed(run), "key long, id long, n int, place int"), "postings")
    members = [F.count("*").alias("c"), F.min("id").alias("a"), F.max("id").alias("z"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    kept = postings.groupBy("key").agg(*members).where("c > 1").groupBy("c", "a", "z", "x", "y").agg(F.min("key").alias("key")).select("key")
    out = materialize(postings.join(kept, "key"), "lists")
    discard([postings])
    return out


class TrieJoin:
    """Overlaps of the sets of a walk with all `fixed` ones at once; sets are ascending arrays, and those that are walked come
    in the order of their trie."""

    def __init__(self, fixed: list[np.ndarray], sizes: np.ndarray, lost: np.ndarray, percent: int, step: int = 16):
        self.sizes, self.lost, self.percent, self.step = sizes, lost, percent, step
        owner, keys = np.repeat(np.arange(len(fixed)), [len(k) for k in fixed]), np.concatenate(fixed)
        order = np.argsort(keys, kind="stable")
        known, first = np.unique(keys[order], return_index=True)
        self.owners = dict(zip(known.tolist(), np.split(owner[order], first[1:]), strict=True))
        self.path: list[int] = []
        self.partial = [np.zeros(len(fixed), np.int64)]

    def partners(self, keys: np.ndarray, size: int, lost: int) -> np.ndarray:
        """The fixed sets that may link with this one of `size` shingles: of shingles that are one value both have lost."""
        need = -(-self.percent * (self.sizes + size) // (100 + self.percent)) - np.minimum(self.lost, lost)
        depth = 0
        for k in keys[: len(self.path)].tolist():
            if self.path[depth] != k:
                break
            depth += 1
        del self.path[depth:], self.partial[depth + 1 :]
        now = self.partial[-1]
        for at in range(depth, len(keys)):
            if (at - depth) % self.step == 0 and not (now + (len(keys) - at) >= need).any():
                return np.empty(0, np.int64)
            k = int(keys[at])
            if (held := self.owners.get(k)) is not None:
                now = now.copy()
                now[held] += 1
            self.path.append(k)
            self.partial.append(now)
        return np.flatnonzero(now >= need)


def _members(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, keys) of wanted(id, doc_id, mark, digest); keys as big-endian bytes, so that they sort as sets. A bitmap of
    the wanted documents lets few others through, and the digest tells those."""
    slots = wanted.select(F.xxhash64("doc_id", "mark").alias("h"))
    marks = bitmap_of(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for b in batches:
            b = b.filter(pa.array(is_marked(marks.value, b.column("h").to_numpy())))
            digests, keys = [], []
            for k in shingle_hashes(texts_of(b)):
                digest = xxhash.xxh3_128_digest(k.tobytes())
                if len(k) and digest not in done:
                    done.add(digest)
                    digests.append(digest)
                    keys.append(k.astype(">u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(keys, pa.binary())], ["digest", "keys"])

    named = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("h"), "text")
    sets = named.mapInArrow(trimmed(run), "digest binary, keys binary").dropDuplicates(["digest"])
    return sets.join(wanted.select("id", "digest"), "digest").select("id", "keys")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk = None, None
        for b in batches:
            out: list[tuple[int, int]] = []
            for x, y, fixed, keys in zip(*(b.column(c).to_pylist() for c in ("a", "b", "fixed", "keys")), strict=True):
                if now != x:
                    now, walk = x, TrieWalk(np.frombuffer(fixed, ">u8").astype(np.uint64), percent)
                if walk.linked(np.frombuffer(keys, ">u8").astype(np.uint64)):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    right = pairs.join(sets.select(F.col("id").alias("b"), "keys"), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("keys").alias("fixed")), "a")
    return both.select("a", "b", "fixed", "keys").sortWithinPartitions("a", "keys").mapInArrow(trimmed(run), "a long, b long")


def _stars(rooted: DataFrame, percent: int, tried: DataFrame | None) -> DataFrame:
    """(a, b), a < b: each document with one that lies in another component and fits by size and place: the least of those that
    one of its lists has in the first place. Pairs that have been tried are left out."""
    centre = F.min_by(F.struct(F.col("id").alias("c"), F.col("n").alias("nc"), F.col("root").alias("rc"), F.col("place").alias("pc")), F.struct("place", "id")).alias("x")
    centres = rooted.groupBy("key").agg(centre).select("key", "x.*")
    need = percent * (F.col("n") + F.col("nc"))
    fits = (F.least("n", "nc") * (100 + percent) >= need) & ((F.col("n") - F.col("place")) * (100 + percent) >= need) & ((F.col("nc") - F.col("pc")) * (100 + percent) >= need)
    pairs = rooted.join(centres, "key").where((F.col("root") != F.col("rc")) & fits).select("id", "c", F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    return pairs.groupBy("id").agg(F.min("c").alias("c")).select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, i, j) and the rows of each block pair of a list, from rows in this order."""
    now, held = None, []
    for b in batches:
        for key, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", *columns)), strict=True):
            if held and (key, i, j) != now:
                yield now, held
                held = []
            now = (key, i, j)
            held.append(row)
    if held:
        yield now, held


_MEMBER = "key long, id long, root long, n int, place int, block int, i int, j int"


def _viable(rooted: DataFrame, percent: int) -> DataFrame:
    """rooted(key, id, root, n, place) by blocks i <= j of its lists: the rows that have a partner in the other block, and in
    another component, with which they can link if key is the first value that they share."""
    names = ["id", "root", "n", "place", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (key, i, j), rows in _grouped(batches, names):
            _, root, n, place, block = all_ = np.array(rows, np.int64).T
            x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
            need = percent * (n[x][:, None] + n[y][None, :])
            rest = (n - place) * (100 + percent)
            fits = (np.minimum(n[x][:, None], n[y][None, :]) * (100 + percent) >= need) & (rest[x][:, None] >= need) & (rest[y][None, :] >= need) & (root[x][:, None] != root[y][None, :])
            keep = np.union1d(x[fits.any(1)], y[fits.any(0)])
            if len(keep):
                here = all_[:, keep]
                out.append([np.full(len(keep), key), *here, np.full(len(keep), i), np.full(len(keep), j)])
                size += len(keep)
            if size > 20_000:
                yield _members_batch(out)
                out, size = [], 0
        yield _members_batch(out)

    blocks = rooted.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rooted.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", *names, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(trimmed(run), _MEMBER)


def _members_batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 8
    types = [pa.int64(), pa.int64(), pa.int64(), *(pa.int32(),) * 5]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], [c.split(" ")[0] for c in _MEMBER.split(", ")])


def _walked(viable: DataFrame, posted: DataFrame, percent: int, tree: bool) -> DataFrame:
    """(a, b), a < b: the pairs of each block pair, in different components, that can link; with tree only as many as join what all of
    these pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _grouped(batches, ["id", "root", "n", "lost", "block", "posted"]):
            sets = [np.frombuffer(r[-1], np.int64) for r in rows]
            ids, roots, sizes, lost, block = np.array([r[:-1] for r in rows], np.int64).T
            out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j).tolist()
            if len(left) and right:
                group = np.unique(roots, return_inverse=True)[1]
                trie = TrieJoin([sets[k] for k in left], sizes[left], lost[left], percent)
                for k in sorted(right, key=lambda k: sets[k].tolist()):
                    found = left[trie.partners(sets[k], int(sizes[k]), int(lost[k]))]
                    found = found[(group[found] != group[k]) if tree else (roots[found] != roots[k]) & ((ids[found] < ids[k]) | (i != j))]
                    if tree:  # one of each group, which all become one
                        found = found[np.unique(group[found], return_index=True)[1]]
                        group[np.isin(group, group[found])] = group[k]
                    out_a.append(np.minimum(ids[found], ids[k]))
                    out_b.append(np.maximum(ids[found], ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    both = viable.join(posted.select("id", "lost", "posted"), "id")
    return both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(trimmed(run), "a long, b long").distinct()


def _roots(docs: DataFrame, lists: DataFrame, posted: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of the ids that link with another one; None if no two do."""
    roots = tried = None
    steps = ["star"] * STARS + ["tree", "all"]
    for step in steps:
        rooted = lists.withColumn("root", F.col("id"))
        if roots is not None:
            rooted = lists.join(roots.select(F.col("node").alias("id"), F.col("root").alias("r")), "id", "left").select("key", "id", "n", "place", F.coalesce("r", "id").alias("root"))
        several = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
        rooted = materialize(rooted.join(several, "key"), "rooted")
        if step == "star":
            pairs = _stars(rooted, percent, tried)
        else:
            viable = materialize(_viable(rooted, percent), "viable")
            pairs = _walked(viable, posted, percent, step == "tree")
            if step == "all":
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        discard([rooted])
        if pairs.isEmpty():
            if step == "tree":
                break
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = materialize(posted.join(ids, "id").select("id", "doc_id", "mark", "digest"), "wanted")
        sets = materialize(_members(docs, wanted), "members")
        found = materialize(_verified(pairs, sets, percent), "links")
        discard([sets, wanted])
        whole = step == "tree" and found.count() == pairs.count()  # nearly always: values that are equal by chance are rare
        if not found.isEmpty():
            roots = components(found if roots is None else found.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
        if whole:
            break
    return roots


def join(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text, ...): the size of its set and the
    smallest doc_id reachable by links 100 |x & y| >= percent |x | y|, its own included.

    Null, empty and word-free texts have an empty set and link with nothing. Rows of a null doc_id take part; the
    component of rows that all lack an id is null. Rows that repeat a doc_id are documents of
    their own. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (6 * PART_KEYS)))  # about six characters a word
    about, values = materialize_by(_chunks(docs, n_parts).withColumn("sent", F.col("part") >= 0), "sent", [False, True], "chunks")
    posted = materialize(_posted(about, values, percent), "posted")
    discard([values])
    one = posted.groupBy("digest").agg(F.min("id").alias("id"))
    classes = materialize(posted.join(one, ["digest", "id"]), "classes")
    roots = _roots(docs, _lists(classes, percent), classes, percent)
    all_ = about.select(F.explode(F.arrays_zip("doc_id", "mark", "n", "digest")).alias("d")).select("d.doc_id", "d.mark", "d.n", "d.digest")
    copies = all_.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    if roots is None:
        named = copies.where("c > 1").select("digest", F.col("least").alias("component"))
    else:
        linked = roots.join(classes.select(F.col("id").alias("node"), "digest"), "node").select("digest", "root")
        found = materialize(copies.join(linked, "digest", "left").where("c > 1 or root is not null").select("digest", "least", "root"), "found")
        least = found.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
        named = found.join(least, "root", "left").select("digest", F.coalesce("component", "least").alias("component"))
    salts = 16  # a third of all rows may have one text
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = all_.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salts)).cast("int")).join(named, ["digest", "salt"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
