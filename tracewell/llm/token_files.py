"""Token-id files: one shared zstandard dictionary, every document its own frame, an offset index per block.

Layout of a written set (all parts are Parquet tables, so the commit protocol of Spark's writer makes a task that is
run again harmless, and any store that Spark reads will do):

* ``dictionary`` - one row: ``dict_hash`` (sha256 of the dictionary), ``width`` (bytes of an id), ``data``
* ``blocks`` - rows ``shard, block, dict_hash, index, payload``.  ``payload`` is frames one after another, ``index`` an
  array of ``(doc_id, start, n_tokens, offset, length)`` with ``start`` counted within the shard.  Documents ascend by
  ``doc_id`` through shards, blocks and index (null ids first, repeated ids by a hash of their ids).

A document is read by its index entry alone: slice ``payload``, decompress with the dictionary.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, rows_of, scratch, table, texts, trimmed, written
from .tokenizing import WORD_BPE, encoder

ENCODED = "doc_id long, n_tokens long, ids binary"
INDEX = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
BLOCKS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("dict_hash", pa.string()), ("index", INDEX), ("payload", pa.binary())])
BLOCKS_DDL = "shard long, block long, dict_hash string, index array<struct<doc_id:long,start:long,n_tokens:long,offset:long,length:long>>, payload binary"
#: The dictionary is fitted on so many documents at most (those with the smallest hash), so many bytes of each, in so many pieces
#: spread over the document, and has so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_PIECES, DICT_BYTES = 1000, 8192, 4, 65536
BLOCK_BYTES = 1 << 20


def encode_documents(docs: DataFrame, tokenizer: tuple[str, bool], end_id: int, width: int = 2) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every whole text, ids as little-endian unsigned integers of ``width`` bytes, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(*tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, text = rows_of(batch.slice(at, 256), "doc_id", "text")
                out = [b + end for b in enc.encode(text)]
                packed = out if width == 4 else [np.frombuffer(b, "<u4").astype(f"<u{width}").tobytes() for b in out]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(b) // 4 for b in out], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(trimmed(run), ENCODED)


def fit_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples to train on give their plain bytes instead, none gives no dictionary."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def samples(encoded: DataFrame) -> list[bytes]:
    """Bytes of the documents with the smallest hashes.  Hashes below a bound that the number of rows gives are grouped
    first, so that a few thousand rows, however many tasks or copies there are, carry bytes."""
    bound = min(1.0, 2 * SAMPLE_DOCS / max(1, encoded.count()))
    least, piece = int((bound - 0.5) * 2**64) - 1, SAMPLE_BYTES // SAMPLE_PIECES
    far = f"CAST((length(ids) - {piece}) / {SAMPLE_PIECES - 1} AS INT)"
    spread = F.concat(*[F.expr(f"substring(ids, 1 + {i} * ({far} - {far} % 4), {piece})") for i in range(SAMPLE_PIECES)])
    taken = F.when(F.length("ids") <= SAMPLE_BYTES, F.col("ids")).otherwise(spread)
    low = encoded.withColumn("h", F.xxhash64("doc_id", "ids")).where(F.col("h") <= min(least, 2**63 - 1)).select("h", taken.alias("s"))
    return [bytes(r.s) for r in low.groupBy("h").agg(F.first("s").alias("s")).orderBy("h").limit(SAMPLE_DOCS).select("s").collect()]


def codec(data: bytes):
    """Compressor and decompressor for a dictionary."""
    import zstandard

    shared = zstandard.ZstdCompressionDict(data) if data else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True), zstandard.ZstdDecompressor(dict_data=shared)


def write_token_files(docs: DataFrame, path: str, tokenizer: tuple[str, bool] = WORD_BPE, end_id: int = 1, width: int = 2) -> None:
    """Encode every document and write the set at ``path``.

    Texts of any length are encoded whole.  Null text counts as empty, so each row of ``docs`` has a frame, if only of the end id.  An empty table gives a set
    without blocks.  Repeated rows are kept.  Encoding runs once, in place; only compressed ids are dealt out by range.
    """
    spark = docs.sparkSession
    encoded = written(encode_documents(docs, tokenizer, end_id, width), "encoded")
    data = fit_dictionary(samples(encoded))
    mark = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(mark, width, data)], "dict_hash string, width int, data binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = codec(data)[0].compress
        shard, block, start, index, payload = TaskContext.get().partitionId(), 0, 0, [], bytearray()

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "dict_hash": mark, "index": index, "payload": bytes(payload)}], BLOCKS)

        for batch in batches:
            for doc_id, n, ids in zip(*rows_of(batch, "doc_id", "n_tokens", "ids"), strict=True):
                frame = squeeze(ids)
                index.append({"doc_id": doc_id, "start": start, "n_tokens": n, "offset": len(payload), "length": len(frame)})
                payload += frame
                start += n
                if len(payload) >= BLOCK_BYTES:
                    yield close()
                    block, index, payload = block + 1, [], bytearray()
        if index:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = encoded.withColumn("tie", F.xxhash64("ids")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n_tokens", "ids")
    dealt.mapInArrow(pack, BLOCKS_DDL).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(spark, encoded)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard, block`` of every document, decompressed from the files; start over all documents."""
    (told,) = spark.read.parquet(f"{path}/dictionary").collect()
    data, width = bytes(told.data), told.width
    if hashlib.sha256(data).hexdigest() != told.dict_hash:
        raise ValueError("the dictionary does not have the hash it is filed under")
    blocks = spark.read.schema(BLOCKS_DDL).parquet(f"{path}/blocks")
    totals = blocks.select("shard", F.expr("aggregate(index, 0L, (a, x) -> a + x.n_tokens)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    before, base = 0, {}
    for r in totals:  # a row for each shard
        base[r.shard], before = before, before + r.n

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_frame = codec(data)[1].decompress
        for batch in batches:
            for shard, block, mark, index, payload in zip(*rows_of(batch, "shard", "block", "dict_hash", "index", "payload"), strict=True):
                if mark != told.dict_hash:
                    raise ValueError(f"block {block} of shard {shard} was written with another dictionary")
                rows = []
                for x in index:
                    ids = np.frombuffer(open_frame(payload[x["offset"] : x["offset"] + x["length"]]), f"<u{width}")
                    rows.append((x["doc_id"], base[shard] + x["start"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard, block))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"])

    return blocks.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, block long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id: one block row and one frame each, found by the index."""
    (told,) = spark.read.parquet(f"{path}/dictionary").collect()
    blocks = spark.read.schema(BLOCKS_DDL).parquet(f"{path}/blocks").where(F.exists("index", lambda x: x.doc_id == doc_id))
    hits = blocks.select(F.explode("index").alias("x"), "payload").where(F.col("x.doc_id") == doc_id)
    frames = hits.select(F.expr("substring(payload, CAST(x.offset + 1 AS INT), CAST(x.length AS INT))").alias("f")).collect()
    open_frame = codec(bytes(told.data))[1].decompress
    return [np.frombuffer(open_frame(bytes(r.f)), f"<u{told.width}").tolist() for r in frames]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
