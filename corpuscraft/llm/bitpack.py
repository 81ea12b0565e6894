"""Token-id files by fixed-width bit packing.

A file is a Parquet table written by Spark whose rows are blocks. A block holds the ids of whole documents, each id in
``bits`` bits (the least that hold the vocabulary's largest id), little-endian, lowest bit first; id ``i`` of a block starts at
bit ``i * bits``, and ``ends`` has the position after each document's last id, so any document or range of ids is unpacked with
numpy alone. Blocks are written in ascending order of document id: ``shard`` and ``block`` number them, ``first`` counts the
ids of the shard's blocks before, ``min_id`` and ``max_id`` bound its documents. A block closes at the first document end at or past ``BLOCK_IDS`` ids.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, steps, task, texts_of
from .tokenize import encoder

BLOCK_IDS = 65_536
SCHEMA = "shard int, block int, first long, bits int, n_ids long, min_id long, max_id long, doc_ids array<bigint>, ends array<bigint>, payload binary"
#: Bytes of a Parquet row group: what a random access reads at most of a file.
ROW_GROUP = 4 << 20


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (below ``2 ** bits``) as one run of bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, at: int, n: int) -> np.ndarray:
    """``n`` ids from position ``at``; only the bytes that hold them are read."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, at * bits // 8).astype(np.uint32)
    low = at * bits
    raw = np.frombuffer(payload, np.uint8)[low // 8 : (low + n * bits + 7) // 8]
    planes = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + n * bits].reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_token_file(df: DataFrame, path: str, tokenizer: str, style: str = "bytes", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each whole text (null: empty), appends ``end_id`` and writes the ids by ascending id at ``path``.

    Texts are dealt by ranges of their id, so each task writes one stretch of the order; a repeated id keeps all its rows, in
    an order of their own (by a hash of the text, so that a hot id is split too), and rows with a null id come first. An empty
    table gives a file without blocks.
    """

    closes = BLOCK_IDS

    def blocks(batches):
        import pyarrow as pa

        enc, end = encoder(tokenizer, style), np.array([end_id], dtype="<u4").tobytes()
        bits, shard = bits_for(max(enc.vocab, end_id + 1)), TaskContext.get().partitionId()
        block = first = 0
        docs, ends, parts, n = [], [], [], 0
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("min_id", pa.int64()), ("max_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])

        def out():
            known = [d for d in docs if d is not None]
            row = [shard, block, first, bits, n, min(known, default=None), max(known, default=None), docs, ends, pack(np.frombuffer(b"".join(parts), "<u4"), bits)]
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema, strict=True)], schema=schema)

        for ids, texts in steps(batches):
            for doc, raw in zip(ids, enc.encode(texts), strict=True):
                docs.append(doc)
                parts.append(raw + end)
                n += len(raw) // 4 + 1
                ends.append(n)
                if n >= closes:
                    yield out()
                    block, first = block + 1, first + n
                    docs, ends, parts, n = [], [], [], 0
        if docs:
            yield out()

    ordered = texts_of(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(task(blocks, "tokenize"), SCHEMA).write.mode("errorifexists").option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the file alone: doc_id, start (ids before it in the whole file), n_tokens, ids (little-endian uint32).

    The ids before each shard are summed from its block headers: one small row for each shard goes to the driver.
    """
    file = spark.read.schema(SCHEMA).parquet(path)
    totals = {r.shard: r.n for r in file.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, before = {}, 0
    for shard in sorted(totals):
        base[shard], before = before, before + totals[shard]

    def docs(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                ends = np.array(row["ends"], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + base[row["shard"]] + row["first"]), pa.array(ends - starts), pa.array([ids[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return file.mapInArrow(task(docs), "doc_id long, start long, n_tokens long, ids binary")


def blocks_of(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The blocks that may hold a document: blocks know their least and greatest id, so that Parquet passes over files and row groups
    (of ``ROW_GROUP`` bytes) that cannot."""
    return spark.read.schema(SCHEMA).parquet(path).filter((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Random access: the ids of one document's rows (several where the id is repeated), unpacked from their own bytes alone."""
    found = blocks_of(spark, path, doc_id).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("shard", "block").collect()
    out = []
    for row in found:
        starts = [0, *row.ends[:-1]]
        out += [unpack(row.payload, row.bits, a, z - a).tolist() for d, a, z in zip(row.doc_ids, starts, row.ends, strict=True) if d == doc_id]
    return out


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes a token file to the shared folder and reads it back."""
    path = Scratch(spark, "tokens").path("ids")
    write_token_file(docs, path, tokenizer)
    return read_token_file(spark, path)
