"""Token files: ids ranked by frequency, in bytes of variable number.

Each id is replaced by its rank among all ids of the corpus (0: the most
frequent), so that most need one byte. The ranks of a block of documents are
written as two streams: control bytes with two bits for each rank (bytes it
takes, less one; the first rank in the lowest bits) and the ranks' bytes, least
first. Blocks are rows of Parquet files; shards follow one another in ascending
``doc_id`` order, so a written file is either whole or, with its executor, not
there at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimsift.llm import chunks
from claimsift.llm.common import new_folder, stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
# Ids in a block, unless one document has more: documents are not cut.
BLOCK_IDS = 1 << 16

BLOCKS = "shard int, start long, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"
READ = "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary"

# For each control byte, the bytes that its four ranks take.
_SIZES = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)
# For each number of bytes, which of four bytes count.
_MASKS = np.array([[0, 0, 0, 0], *[[0xFF if k < n else 0 for k in range(4)] for n in range(1, 5)]], dtype=np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = sizes - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """What ``pack`` was given: sizes come from a table, bytes from masks of another."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:count]
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data + bytes(3), np.uint8)
    out = np.zeros(count, dtype=np.uint32)
    masks = _MASKS[sizes]
    for k in range(4):
        out |= (raw[starts + k] & masks[:, k]) << np.uint32(8 * k)
    return out


def width(path: str, end_id: int = END_ID) -> int:
    """Bytes that hold any id while it waits for its rank."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return 2 if max(end_id, *tokenizer.get_vocab().values()) < 1 << 16 else 4


def encoded(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, ids)``: the ids of each whole text with ``end_id`` behind, as
    little-endian unsigned integers of ``width`` bytes. A null text is empty."""
    size = width(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunks.encoder(path, spaces=False)
        for batch in batches:
            for part in chunks.slices(batch, "text"):
                out = coder.encode(part.column(1))
                ends = np.cumsum(out["counts"])
                ids = np.insert(out["ids"], ends, end_id).astype(f"<u{size}")
                edges = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                raw = pa.Array.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer((edges * size).astype(np.int64)), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays([part.column(0), raw.cast(pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def frequencies(ids: DataFrame, size: int) -> DataFrame:
    """``(id, n)`` over all documents, counted in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{size}"))
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, folder: str, path: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Write the token files of ``docs`` (doc_id, text) into ``folder``.

    The texts are encoded once; ids wait in the shared folder while they are
    counted. The driver and the tasks hold one number for each id of the
    vocabulary and nothing that grows with the documents. Documents with the
    same ``doc_id`` are ordered by their ids; one without comes first. An empty
    table gives an empty folder of blocks.
    """
    ids = stored(encoded(docs, path, end_id), "token-ids")
    size = width(path, end_id)
    counted = frequencies(ids, size).orderBy(F.desc("n"), "id")
    vocabulary = np.array([r.id for r in counted.select("id").collect()], dtype=np.uint32)
    spark = docs.sparkSession
    spark.createDataFrame([(i, int(v)) for i, v in enumerate(vocabulary)], "rank int, id long").coalesce(1).write.parquet(f"{folder}/vocabulary")
    ranks = np.zeros(int(vocabulary.max()) + 1 if len(vocabulary) else 1, dtype=np.uint32)
    ranks[vocabulary] = np.arange(len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lengths = np.array([len(x) // size for x in raw], dtype=np.int64)
            ends, a = np.cumsum(lengths), 0
            while a < len(raw):
                base = int(ends[a] - lengths[a])
                b = max(a + 1, int(np.searchsorted(ends, base + BLOCK_IDS, "right")))
                control, data = pack(ranks[np.frombuffer(b"".join(raw[a:b]), f"<u{size}")])
                row = [shard, start, keys[a:b], lengths[a:b].tolist(), control, data]
                types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(row, types)], ["shard", "start", "doc_ids", "lengths", "control", "data"]
                )
                start, a = start + int(ends[b - 1]) - base, b

    # The last key splits what has the same doc_id and ids; shards are ranges.
    order = ["doc_id", "_same", "_row"]
    keyed = ids.withColumns({"_same": F.xxhash64("ids"), "_row": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    ranged.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of ``write``'s files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 and ids (unsigned 32-bit integers)."""
    vocabulary = np.array([r.id for r in spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in range(batch.num_rows):
                shard, start, keys, lengths, control, data = (c[block].as_py() for c in batch.columns)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                raw = vocabulary[unpack(control, data, int(edges[-1]))].tobytes()
                ids = [raw[4 * a : 4 * b] for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(keys), pa.int32()),
                        pa.array(keys, pa.int64()),
                        pa.array(edges[:-1] + start, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["shard", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row for each shard: as many as the write had tasks.
    earlier = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("shard", F.coalesce(earlier, F.lit(0)).alias("before"))
    return (
        blocks.mapInArrow(run, READ)
        .join(F.broadcast(before), "shard")
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op9: all documents encoded, written to token files and read back."""
    place = new_folder(spark, "token-files")
    write(table(spark, folder, "documents"), place)
    return read(spark, place).drop("ids")
