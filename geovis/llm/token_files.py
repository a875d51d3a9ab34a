"""Token id files for random access: documents in ascending id order, each compressed on its own.

One zstandard dictionary, trained on the serialized id arrays of a bounded sample, is shared by
all documents, so that even a short document compresses well and can be read without its
neighbours. Documents are kept in blocks:

    magic `GVT1` | width of an id in bytes | documents n | SHA-256 of the dictionary
    n + 1 frame offsets | n id counts | n document ids | n null flags | frames

(little-endian unsigned 64-bit numbers, document ids signed, flags one byte each.) Blocks are
binary values of a Parquet table, one folder `blocks` with the id range and the number of ids of
each block beside it, and a folder `dictionary`. Spark writes and commits them, so they live in
any store Spark reaches, and a lost task leaves nothing behind. `lookup` finds a block by its id
range in the Parquet statistics, the document by its index, and decompresses one frame.

Defined results: a null or empty text has the end id alone; repeated ids stay next to each other,
in the order of their texts' checksums; a null doc_id sorts first; an empty table gives an empty folder that reads back as no rows.
If there is too little text to train a dictionary, an empty one is used.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, id_and_text, map_arrow, record, slices
from geovis.llm.word_tokens import word_ids

MAGIC = b"GVT1"
HEAD = struct.Struct("<4sQQ32s")
SAMPLE_DOCUMENTS = 500
SAMPLE_CHARACTERS = 20_000
DICTIONARY_BYTES = 64 * 1024
BLOCK_BYTES = 1 << 20
BLOCK_DOCUMENTS = 4096


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False, **shared)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdDecompressor(**shared)


def encode_block(rows: list[tuple[int | None, int, bytes]], width: int, dictionary_hash: bytes) -> bytes:
    """A block of (document id, number of ids, frame)."""
    ids, counts, frames = zip(*rows, strict=True)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    return b"".join([
        HEAD.pack(MAGIC, width, len(rows), dictionary_hash), offsets.tobytes(), np.array(counts, "<u8").tobytes(),
        np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), *frames,
    ])


class Block:
    """Index of a block; `ids(k)` reads one document."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        magic, self.width, n, of = HEAD.unpack_from(data)
        if magic != MAGIC or of != hashlib.sha256(dictionary).digest():
            raise ValueError("not a block of token ids, or written with another dictionary")
        at = HEAD.size
        self.offsets = np.frombuffer(data, "<u8", n + 1, at)
        self.counts = np.frombuffer(data, "<u8", n, at + 8 * (n + 1))
        self.keys = np.frombuffer(data, "<i8", n, at + 8 * (2 * n + 1))
        self.nulls = np.frombuffer(data, np.uint8, n, at + 8 * (3 * n + 1))
        self.data, self.frames = memoryview(data), at + 8 * (3 * n + 1) + n

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, k: int, opener: zstandard.ZstdDecompressor) -> np.ndarray:
        frame = self.data[self.frames + int(self.offsets[k]) : self.frames + int(self.offsets[k + 1])]
        return np.frombuffer(opener.decompress(frame), f"<u{self.width}").astype("<u4")


def serialized(docs: DataFrame, vocabulary: str, width: int, end_id: int) -> DataFrame:
    end = end_id.to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema = word_ids(vocabulary, width), arrow_schema(ids=pa.binary())
        for batch in slices(batches, 500):
            yield record(schema, [x + end for x in encoder.encode(batch.column(1).to_pylist())])

    return map_arrow(id_and_text(docs), encode, "ids binary")


def train(docs: DataFrame, vocabulary: str, width: int, end_id: int) -> bytes:
    """A dictionary from SAMPLE_DOCUMENTS documents of at most SAMPLE_CHARACTERS characters,
    those whose id has the smallest hash."""
    short = docs.filter(F.length("text") <= SAMPLE_CHARACTERS)
    few = short.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_DOCUMENTS)
    samples = [bytes(r["ids"]) for r in serialized(few, vocabulary, width, end_id).collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, vocabulary_size: int = 49_408) -> None:
    """Write the files of all documents below `folder`.

    Documents are dealt into one range of ids for each shuffle partition. The range bounds come
    from the ids alone; the text is encoded once, and only compressed ids are shuffled.
    """
    spark = docs.sparkSession
    width = 2 if vocabulary_size <= 1 << 16 else 4
    docs = id_and_text(docs)
    dictionary = train(docs, vocabulary, width, end_id)
    dictionary_hash = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(dictionary_hash.hex(), dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] if shares else []
    bounds = np.unique(np.array(found or [], np.int64))
    end = end_id.to_bytes(width, "little")
    documents = arrow_schema(range=pa.int32(), doc_id=pa.int64(), n=pa.int64(), crc=pa.int64(), frame=pa.binary())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = word_ids(vocabulary, width), compressor(dictionary)
        for batch in slices(batches, 500):
            keys = batch.column(0)
            serial = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
            at = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(), side="left")
            yield record(documents, at.astype(np.int32), keys, [len(x) // width for x in serial], [zlib.crc32(x) for x in serial], [press.compress(x) for x in serial])

    schema = arrow_schema(range=pa.int32(), block=pa.int64(), first_id=pa.int64(), last_id=pa.int64(), n_documents=pa.int64(), n_tokens=pa.int64(), data=pa.binary())

    def block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, block, of = [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            known = [r[0] for r in rows if r[0] is not None]
            return record(schema, [of], [block], [min(known, default=None)], [max(known, default=None)], [len(rows)], [sum(r[1] for r in rows)], [encode_block(rows, width, dictionary_hash)])

        for batch in slices(batches, 1000):
            at, keys, counts, _, frames = (c.to_pylist() for c in batch.columns)
            of = at[0]
            for row in zip(keys, counts, frames, strict=True):
                rows.append(row)
                held += len(row[2])
                if held >= BLOCK_BYTES or len(rows) == BLOCK_DOCUMENTS:
                    yield closed()
                    rows, held, block = [], 0, block + 1
        if rows:
            yield closed()

    frames = map_arrow(docs, encode, "range int, doc_id long, n long, crc long, frame binary")
    ordered = frames.repartitionById(ranges, F.col("range")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "crc", "n")
    blocks = map_arrow(ordered, block_up, "range int, block long, first_id long, last_id long, n_documents long, n_tokens long, data binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def stored_dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not have its hash")
    return dictionary


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, and with `with_ids`
    its ids as little-endian unsigned 32-bit integers."""
    dictionary = stored_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    schema = arrow_schema(range=pa.int32(), block=pa.int64(), doc_id=pa.int64(), before=pa.int64(), n_tokens=pa.int64(), ids_crc32=pa.int64(), **({"ids": pa.binary()} if with_ids else {}))

    def open_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = decompressor(dictionary)
        for batch in slices(batches, 1):
            block = Block(batch.column(2)[0].as_py(), dictionary)
            n, before = len(block), np.cumsum(block.counts) - block.counts
            keys = pa.array(block.keys, mask=block.nulls.astype(bool))
            for start in range(0, n, 256):
                some = slice(start, min(n, start + 256))
                ids = [block.ids(k, opener).tobytes() for k in range(some.start, some.stop)]
                size = len(ids)
                yield record(
                    schema, np.repeat(batch.column(0).to_numpy(), size), np.repeat(batch.column(1).to_numpy(), size), keys[some],
                    before[some].astype(np.int64), [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], *([ids] if with_ids else []),
                )

    extra = ", ids binary" if with_ids else ""
    rows = map_arrow(blocks.select("range", "block", "data"), open_up, f"range int, block long, doc_id long, before long, n_tokens long, ids_crc32 long{extra}")
    # Ids before a block: those of earlier ranges (one row per range) and of earlier blocks of its range.
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_range = blocks.groupBy("range").agg(F.sum("n_tokens").alias("n_tokens"))
    per_range = per_range.select("range", earlier(Window.orderBy("range")).alias("range_start"))
    per_block = blocks.select("range", "block", earlier(Window.partitionBy("range").orderBy("block")).alias("block_start"))
    starts = per_block.join(per_range, "range").select("range", "block", (F.col("range_start") + F.col("block_start")).alias("block_start"))
    out = rows.join(starts, ["range", "block"]).withColumn("start", F.col("block_start") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def lookup(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id: only blocks whose id range holds it are read, and
    only its frames are decompressed."""
    dictionary = stored_dictionary(spark, folder)
    opener, found = decompressor(dictionary), []
    near = spark.read.parquet(f"{folder}/blocks").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for row in near.select("range", "block", "data").orderBy("range", "block").toLocalIterator():
        block = Block(bytes(row["data"]), dictionary)
        found += [block.ids(int(k), opener) for k in np.flatnonzero((block.keys == doc_id) & (block.nulls == 0))]
    return found
