"""Token ids in files of our own format: frequency-ranked ids, byte-aligned, control bytes apart from data.

An id is written as its rank by frequency in the corpus, in one to four bytes, least significant first.
Two bits of a control byte give the length (less one) of each of four ids; a document's last control byte
may have unused slots. A block holds whole documents in ascending doc_id order:

    bucket, seq       place of the block: by bucket (a range of the order), then by seq
    doc_ids, lengths  the documents and how many ids each has
    start             ids of the bucket before the block
    n_ids             ids in the block
    control, data     the documents' control bytes, then their data bytes, one document after another

Blocks are rows of Parquet files, since that is what every store that Spark reads can hold. The rank table
(at most one entry per id of the vocabulary) is a table beside them. Decoding looks the control bytes up in
a table of 256 x 4 lengths and gathers the bytes with numpy; nothing loops over ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, scratch_root, small_batches, texts_of, trimmed
from .encoding import encode_text, vocabulary_size

#: Fixed by the format: byte lengths of the four slots of each control byte.
SLOT_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: A table of bucket offsets is broadcast up to this many buckets, joined by shuffle beyond.
MOST_BROADCAST_BUCKETS = 100_000


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    slots = np.zeros(-(-n // 4) * 4, np.uint8)
    slots[:n] = size - 1
    slots = slots.reshape(-1, 4)
    control = slots[:, 0] | slots[:, 1] << 2 | slots[:, 2] << 4 | slots[:, 3] << 6
    octets = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """The ranks of a block whose documents have these numbers of ids."""
    per = -(-lengths // 4)
    size = SLOT_LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    last = np.cumsum(per) * 4
    used = np.ones(len(size), bool)
    for k in range(1, 4):  # unused slots stand at the end of a document
        used[(last - k)[(per * 4 - lengths >= k)]] = False
    size = size[used]
    at = np.cumsum(size) - size
    octets = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = octets[at]
    for k in range(1, 4):
        more = size > k
        out[more] |= octets[at[more] + k] << np.uint32(8 * k)
    return out


def _split(ids: np.ndarray) -> bytes:
    """All first bytes of the ids, then all second ones, ...: of small ids half are zeros, which files hold in no space."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _read_split(octets: bytes) -> np.ndarray:
    return np.frombuffer(octets, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.append(encode_text(path, text), np.uint32(end_id)) for text in texts_of(b)]
            split = [_split(x) for x in ids]
            check = [zlib.crc32(x) for x in split]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(check, pa.int64()), pa.array(split, pa.binary())], ["doc_id", "n", "check", "ids"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n long, check long, ids binary")


def _id_counts(ids: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            held = [_read_split(x) for x in b.column("ids").to_pylist()]
            total += np.bincount(np.concatenate([*held, np.empty(0, np.uint32)]).astype(np.int64), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(trimmed(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, ids_per_bucket: int = 4_000_000, ids_per_block: int = 65_536) -> str:
    """Write docs(doc_id, text, ...) to `path` (a new folder in the shared one by default); returns the path.

    Null and empty texts are the end id alone. Documents lie in ascending doc_id order, null ids first; of
    repeated ids the shorter document comes first, then the one of the smaller checksum. Buckets are ranges of
    that order, so the documents of one id, or of none, may fill many. Other columns are ignored; an empty table writes no
    block.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = path or f"{scratch_root(spark)}/ids-{np.random.default_rng().integers(1 << 62):x}"
    ids = materialize(_tokenize(docs, tokenizer_path, end_id), "tokens")
    size = max(vocabulary_size(tokenizer_path), end_id + 1)
    counts = sorted(((-r["n"], r["id"]) for r in _id_counts(ids, size).collect()))  # one row for each id of the vocabulary
    by_rank = np.array([i for _, i in counts], np.int64)
    rank_of = np.zeros(size, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    n_buckets = max(12, -(-int(-sum(c for c, _ in counts)) // ids_per_bucket))
    ranks = spark.sparkContext.broadcast(rank_of)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "seq", "doc_ids", "lengths", "start", "n_ids", "control", "data"]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        bucket, seq, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            row = [bucket, seq, [x[0] for x in held], [x[1] for x in held], start, size, b"".join(x[2] for x in held), b"".join(x[3] for x in held)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for b in batches:
            for doc, n, split in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                if held and size + n > ids_per_block:
                    yield flush()
                    seq, start, held, size = seq + 1, start + size, [], 0
                held.append((doc, n, *encode_ranks(ranks.value[_read_split(split)])))
                size += n
        if held:
            yield flush()

    order = [F.asc_nulls_first("doc_id"), F.col("n"), F.col("check")]
    (
        ids.withColumn("row", F.monotonically_increasing_id())  # splits the rows of one id
        .repartitionByRange(n_buckets, *order, "row")
        .sortWithinPartitions(*order, "row")
        .select("doc_id", "n", "ids")
        .mapInArrow(trimmed(block), "bucket int, seq int, doc_ids array<long>, lengths array<long>, start long, n_ids long, control binary, data binary")
        .write.option("compression", "zstd")
        .parquet(f"{path}/blocks")
    )
    discard([ids])
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; ids as little-endian uint32."""
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # one row for each id of the vocabulary
    by_rank = spark.sparkContext.broadcast(np.array([r["id"] for r in table] or [0], np.uint32))
    buckets = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = buckets.select("bucket", before.alias("bucket_start"))
    n = buckets.count()
    placed = blocks.join(F.broadcast(offsets) if n <= MOST_BROADCAST_BUCKETS else offsets, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, start, docs, lengths, control, data in zip(*(b.column(c).to_pylist() for c in ("bucket_start", "start", "doc_ids", "lengths", "control", "data")), strict=True):
                lengths = np.array(lengths, np.int64)
                ids = by_rank.value[decode_ranks(control, data, lengths)]
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(base + start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    columns = ["bucket_start", "start", "doc_ids", "lengths", "control", "data"]
    return placed.select(*columns).mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
