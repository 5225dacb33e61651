"""Packing documents into windows of tokens by non-negative least squares.

A document longer than the window gives whole windows; what remains of each document is a piece. Pieces are
dealt by a hash into shards of bounded size, which tasks pack on their own:

1. Histogram the pieces' lengths in units (window / 64, rounded up).
2. Enumerate the shallow combinations: the multisets of at most `depth` lengths that fill the window.
3. Solve min |A x - h| for x >= 0 (Lawson and Hanson's active sets), h the histogram, and round x to repeat counts.
4. Draw pieces by these counts; pack the residual pieces greedily into the gaps (best fit, longest first).
5. Documents may be cut: the emptiest sequences are dissolved, and their pieces, cut, close the other gaps of
   at least `least_gap` tokens. The last tokens of a shard become sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, texts_of, trimmed
from .encoding import encode_text, vocabulary_size

UNITS = 64


@lru_cache(maxsize=4)
def combinations(units: int, depth: int) -> np.ndarray:
    """Rows: how often each length 1..units occurs in a multiset of at most `depth` lengths summing to units."""
    found: list[list[int]] = []

    def grow(rest: int, most: int, parts: list[int]) -> None:
        if not rest:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(min(rest, most), 0, -1):
                if x * (depth - len(parts)) < rest:
                    break
                grow(rest - x, x, [*parts, x])

    grow(units, units, [])
    out = np.zeros((len(found), units))
    for k, parts in enumerate(found):
        for x in parts:
            out[k, x - 1] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets (Lawson and Hanson 1974)."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = 0
        if (k := int(np.argmax(gradient))) < 0 or gradient[k] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        passive[k] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = float(np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)))
            x[at] += step * (s - x[at])
            passive[at[(x[at] <= 1e-12) | (low & (x[at] <= 1e-9))]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def pack(lengths: np.ndarray, window: int, depth: int = 4, least_gap: int = 8) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, first token, tokens) that hold every token of pieces of 1..window tokens once."""
    if window < UNITS:
        raise ValueError(f"a window has at least {UNITS} tokens")
    unit = window / UNITS
    binned = np.minimum(np.ceil(lengths / unit).astype(int), UNITS)
    supply: list[list[int]] = [[] for _ in range(UNITS + 1)]
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        supply[binned[i]].append(int(i))
    combos = combinations(UNITS, depth)
    repeats = np.rint(nnls(combos.T, np.bincount(binned, minlength=UNITS + 1)[1:].astype(float))).astype(int)
    sequences: list[list[tuple[int, int, int]]] = []
    for k in np.argsort(-repeats, kind="stable"):
        parts = [(int(x) + 1, int(m)) for x, m in zip(np.flatnonzero(combos[k]), combos[k][combos[k] > 0], strict=True)]
        for _ in range(min(int(repeats[k]), *(len(supply[x]) // m for x, m in parts))):
            sequences.append([(i, 0, int(lengths[i])) for x, m in parts for i in (supply[x].pop() for _ in range(m))])
    gaps = sorted((window - sum(p[2] for p in s), n) for n, s in enumerate(sequences))
    for i in sorted((i for held in supply for i in held), key=lambda i: (-lengths[i], i)):
        n = int(lengths[i])
        if (at := bisect_left(gaps, (n, -1))) < len(gaps):
            gap, k = gaps.pop(at)
        else:
            gap, k = window, len(sequences)
            sequences.append([])
        sequences[k].append((i, 0, n))
        if gap > n:
            insort(gaps, (gap - n, k))
    return _close_gaps(sequences, window, least_gap)


def _close_gaps(sequences: list[list[tuple[int, int, int]]], window: int, least_gap: int) -> list[list[tuple[int, int, int]]]:
    order = sorted(range(len(sequences)), key=lambda k: (-sum(p[2] for p in sequences[k]), k))
    first, last, loose = 0, len(order) - 1, []
    while first <= last:
        gap = window - sum(p[2] for p in sequences[order[first]])
        while gap >= least_gap and (loose or first < last):
            if not loose:
                loose = sequences[order[last]][::-1]
                sequences[order[last]] = []
                last -= 1
                continue
            piece, start, n = loose.pop()
            sequences[order[first]].append((piece, start, min(n, gap)))
            if n > gap:
                loose.append((piece, start + gap, n - gap))
            gap -= min(n, gap)
        if gap >= least_gap and first == last:  # only the last has nothing to draw on
            loose = [*sequences[order[first]][::-1]]
            sequences[order[first]] = []
        first += 1
    out = [s for s in sequences if s]
    rest = sum(p[2] for p in loose)
    while rest:
        size = 1 << rest.bit_length() - 1
        rest, now = rest - size, []
        while size:
            piece, start, n = loose.pop()
            now.append((piece, start, min(n, size)))
            if n > size:
                loose.append((piece, start + size, n - size))
            size -= min(n, size)
        out.append(now)
    return out


def _tokens(docs: DataFrame, tokenizer_path: str, end_id: int, window: int) -> DataFrame:
    """(row, doc_id, n, crc, part, ids): a row for each `window` ids of each document and for what remains; row numbers
    documents, n counts the document's ids, and crc is that of all of them."""
    kind = "<u2" if max(vocabulary_size(tokenizer_path), end_id) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            rows, size = [], 0
            for doc, text in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), texts_of(b), strict=True):
                ids = np.append(encode_text(tokenizer_path, text), np.uint32(end_id)).astype(kind)
                crc = zlib.crc32(ids.tobytes())
                for at in range(0, len(ids), window):
                    rows.append((number, doc, len(ids), crc, at // window, ids[at : at + window].tobytes()))
                number, size = number + 1, size + len(ids)
                if size > MOST_IDS:
                    yield _batch(rows, _TOKENS)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, _TOKENS)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "row long, doc_id long, n long, crc long, part int, ids binary")


#: Ids in one Arrow batch.
MOST_IDS = 1 << 20
_TOKENS = {"row": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "crc": pa.int64(), "part": pa.int32(), "ids": pa.binary()}
_PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def _shards(lengths: DataFrame, docs_per_shard: int, ids_per_shard: int) -> DataFrame:
    """lengths(row, doc_id, n, crc) with shard and sub: dealt by a hash of id and crc, so the layout of the files doesn't
    matter; only a shard that comes out twice as large as it should, by repeated rows, is dealt on by row."""
    total = lengths.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids")).first()
    shards = max(1, -(-total["docs"] // docs_per_shard), -(-total["ids"] // ids_per_shard))
    dealt = lengths.withColumn("shard", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(shards)))
    times = F.greatest(F.count("*") / docs_per_shard, F.sum("n") / ids_per_shard)
    large = dealt.groupBy("shard").agg(times.alias("times"), F.count("*").alias("docs")).where("times >= 2 and docs > 1")
    large = large.select("shard", F.ceil("times").alias("subs"))
    return dealt.join(large, "shard", "left").withColumn("sub", F.when(F.col("subs") > 0, F.pmod(F.xxhash64("row"), "subs")).otherwise(F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 4096, depth: int = 4, docs_per_shard: int = 6_000, ids_per_shard: int = 6_000_000) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of each piece of docs(doc_id, text, ...).

    `ids` are the piece's ids as little-endian uint32, `start` counts the document's ids before it. Null and
    empty texts are the end id alone; a null doc_id stays null, and rows that repeat an id are documents of
    their own; other columns are ignored; an empty table gives an empty one. A sequence is padded to `window`
    unless its length is a power of two. A shard holds about `docs_per_shard` documents and `ids_per_shard` ids, but no
    ids themselves: these are joined to the pieces afterwards, at most a window of them at a time. So a task's memory is
    bounded; sequence ids are shard x 2^40 + sub x 2^24 + the number in it.
    """
    small_batches(docs.sparkSession)
    tokens = materialize(_tokens(docs, tokenizer_path, end_id, window), "tokens")
    dealt = _shards(tokens.where("part = 0").select("row", "doc_id", "n", "crc"), docs_per_shard, ids_per_shard)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "crc", "n", "row"], na_position="first", kind="stable")
        n = rows["n"].to_numpy()
        rest = n % window
        whole, at = [], []
        for d in np.flatnonzero(n >= window):
            whole += [[(int(d), s, window)] for s in range(0, int(n[d]) - window + 1, window)]
        own = np.flatnonzero(rest)
        sequences = whole + [[(int(own[p]), int(n[own[p]] - rest[own[p]]) + s, m) for p, s, m in q] for q in pack(rest[own], window, depth)]
        for k, q in enumerate(sequences):
            offset = 0
            for d, s, m in q:
                at.append((d, s, m, k, offset))
                offset += m
        d, s, m, k, offset = (np.array(x, np.int64) for x in zip(*at, strict=True))
        return pd.DataFrame({"row": rows["row"].to_numpy()[d], "part": (s // window).astype(np.int32), "start": s, "length": m, "sequence_id": (int(key[0]) << 40) + (int(key[1]) << 24) + k, "offset": offset})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, start, length, ids, n, sequence, offset in zip(*(b.column(c).to_pylist() for c in _PIECES), strict=True):
                held = np.frombuffer(ids, kind).astype("<u4")
                out.append((doc, start, length, held[start % window : start % window + length].tobytes(), n, sequence, offset))
            yield _batch(out, _PIECES)

    kind = "<u2" if max(vocabulary_size(tokenizer_path), end_id) < 1 << 16 else "<u4"
    pieces = dealt.groupBy("shard", "sub").applyInPandas(run, "row long, part int, start long, length long, sequence_id long, offset long")
    found = pieces.join(tokens.select("row", "part", "doc_id", F.col("n").alias("doc_tokens"), "ids"), ["row", "part"]).select(*_PIECES)
    return found.mapInArrow(trimmed(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
