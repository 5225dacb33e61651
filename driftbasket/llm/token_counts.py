"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact table of the frequent pre-tokens' lengths, broadcast (its size is a parameter).
Tier 2 is a bounded cache in each Python worker, which it keeps from task to task; what misses both is encoded by the
library, a batch at a time. No pre-token is ever shuffled, and one pass over the texts is all there is.

A text may be cut before every single space that stands before a non-space: no match of the byte-level
pre-tokenization pattern spans such a place. So the pieces are encoded one by one, and repeated pieces
are encoded once. Texts that hold the string of a special token go to the library whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import latin
from .common import small_batches, texts_of, trimmed

_SPACE_RUN = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r"(?= \S)")


def pieces(text: str) -> list[str]:
    """Pieces whose token sequences, one after another, are the text's. The first keeps its beginning;
    each later piece stands for itself with one space before it."""
    if not _SPACE_RUN.search(text):
        return text.split(" ")
    first, *rest = _CUT.split(text)
    return [first, *(x[1:] for x in rest)]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:  # without loading the library's tokenizer, which few texts need
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


def encode_pieces(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of texts without special strings."""
    fast = latin(path)
    out = [fast.ids(x) if fast and fast.takes(x) else None for x in texts]
    if rest := [i for i, x in enumerate(out) if x is None]:
        for i, got in zip(rest, tokenizer(path).encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = got.ids
    return out


class PieceLengths:
    """Token counts of texts; at most `limit` pieces are kept beside the broadcast table."""

    def __init__(self, path: str, frequent: dict[str, int], limit: int = 400_000):
        self.path, self.frequent, self.limit, self.cache = path, frequent, limit, dict(frequent)

    def with_frequent(self, frequent: dict[str, int]) -> PieceLengths:
        self.frequent = frequent
        self.cache.update(frequent)
        return self

    def batch(self, texts: list[str]) -> list[int]:
        tok, special = tokenizer(self.path), special_strings(self.path)
        out, cut = [0] * len(texts), []
        for i, text in enumerate(texts):
            if any(s in text for s in special):
                out[i] = len(tok.encode(text, add_special_tokens=False).ids)
            elif text:
                first, *rest = pieces(text)
                cut.append((i, first, rest))
        cache = self.cache
        missing = set()
        for _, _, rest in cut:
            missing.update(set(rest).difference(cache))
        if len(cache) + len(missing) > self.limit + len(self.frequent):
            cache = self.cache = dict(self.frequent)
            missing = set().union(*(set(rest).difference(cache) for _, _, rest in cut))
        missing = list(missing)
        for piece, got in zip(missing, encode_pieces(self.path, [" " + x for x in missing]), strict=True):
            cache[piece] = len(got)
        heads = encode_pieces(self.path, [first for _, first, _ in cut])
        for (i, _, rest), head in zip(cut, heads, strict=True):
            out[i] = len(head) + sum(map(cache.__getitem__, rest))
        return out


#: Of this process, by tokenizer file: lengths of pieces depend on nothing else.
_kept: dict[str, PieceLengths] = {}


def piece_lengths(path: str, frequent: dict[str, int]) -> PieceLengths:
    if path not in _kept:
        _kept[path] = PieceLengths(path, frequent)
    return _kept[path].with_frequent(frequent)


def frequent_pieces(docs: DataFrame, path: str, table_size: int, sample_docs: int, seed: int = 7) -> dict[str, int]:
    """Lengths of the commonest pieces of about `sample_docs` documents. It decides what is looked up
    first, never a result."""
    n = docs.count()
    if not n:
        return {}
    rows = docs.select("text").sample(False, min(1.0, sample_docs / n), seed).toLocalIterator()
    seen: Counter = Counter()
    for r in rows:
        if r[0]:
            seen.update(pieces(r[0])[1:])
    common = [x for x, _ in seen.most_common(table_size)]
    got = encode_pieces(path, [" " + x for x in common])
    return {x: len(g) for x, g in zip(common, got, strict=True) if len(g) < 256}


def _slices(texts: list[str], chars: int = 4_000_000) -> Iterable[tuple[int, list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > chars:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, table_size: int = 32_768, sample_docs: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs(doc_id, text, ...), repeated rows each.

    Nulls and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; other columns are ignored;
    an empty table gives an empty one. `limit`: over_limit is n_tokens > limit. The broadcast table holds
    `table_size` pieces of at most about `sample_docs` documents.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_pieces(docs, path, table_size, sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = piece_lengths(path, known.value)
        for b in batches:
            texts = texts_of(b)
            n = [x for _, part in _slices(texts) for x in lengths.batch(part)]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
