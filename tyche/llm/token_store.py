"""Token ids in compressed blocks with a shared dictionary.

The store is a folder with two Parquet tables. ``dictionary`` holds one row: ``dict_hash`` and the bytes of a
zstandard dictionary. ``blocks`` has one row per block of consecutive documents: the range of its ids, their
``offsets`` in ``payload`` (one zstandard frame per document), the token counts, the hash of the dictionary, and
``shard`` with ``shard_start``, the number of tokens before the block within its shard. Shards and blocks ascend
by document id, so a reader finds a document by the block statistics and inflates its frame alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import mapped
from .token_counts import balanced

BLOCKS = "shard int, shard_start long, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, id_bytes int, dict_hash string, payload binary"
#: Documents whose ids train the dictionary, the ids taken from each, and the dictionary's size in bytes.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 1000, 2048, 65_536
#: A block ends once its frames reach this many bytes.
BLOCK_BYTES = 1 << 20


def id_width(vocabulary: str) -> int:
    return 2 if encoder(vocabulary).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, sample_docs: int = SAMPLE_DOCS, sample_ids: int = SAMPLE_IDS) -> bytes:
    """A dictionary from the first ``sample_ids`` ids of the ``sample_docs`` documents with the smallest hashes of their id.

    The sample only shapes the dictionary; every document is written whole. Too few ids give an empty dictionary.
    """
    import zstandard

    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text")
    width = id_width(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [serialized(x, end_id, width)[: sample_ids * width] for x in map(encoder(vocabulary).ids, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in mapped(texts, encoded, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sorted(samples)).as_bytes()
    except zstandard.ZstdError:
        return b""


def serialized(ids: bytes, end_id: int, width: int) -> bytes:
    return np.append(np.frombuffer(ids, "<u4"), end_id).astype(f"<u{width}").tobytes()


def write_token_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, sample_docs: int = SAMPLE_DOCS) -> None:
    """Writes the ids of all ``docs`` (``doc_id``, ``text``), ``end_id`` appended to each, in ascending doc_id order.

    A null text is the end id alone, null ids come first, repeated rows are written each, other columns are not
    read; an empty table gives a store without blocks.
    """
    import zstandard

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary, width = train_dictionary(docs, vocabulary, end_id, sample_docs), id_width(vocabulary)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True).compress
        encode, shard, total, size = encoder(vocabulary).ids, TaskContext.get().partitionId(), 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []

        def block() -> pa.RecordBatch:
            known = [x for x in ids if x is not None] or [None]
            row = {
                "shard": shard, "shard_start": total - sum(counts), "first_id": known[0], "last_id": known[-1], "doc_ids": ids, "n_tokens": counts,
                "offsets": np.cumsum([0, *map(len, frames)]).tolist(), "id_bytes": width, "dict_hash": dict_hash, "payload": b"".join(frames),
            }
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in balanced(batches, 1):
            for doc_id, plain in zip(batch.column(0).to_pylist(), map(encode, batch.column(1).to_pylist()), strict=True):
                frame = serialized(plain, end_id, width)
                ids.append(doc_id)
                counts.append(len(frame) // width)
                frames.append(compress(frame))
                total, size = total + counts[-1], size + len(frames[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield block()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    mapped(ordered, blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_store(spark: SparkSession, path: str, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from a store; ``start`` counts the ids of all documents before.

    ``doc_ids`` (lowest, highest) reads only the blocks that overlap this range and inflates only its documents.
    Shard totals, one row for each written file, are summed on the way; ids are little-endian 32-bit integers.
    """
    import zstandard

    found = spark.read.parquet(f"{path}/dictionary").first()
    dict_hash, dictionary = found.dict_hash, bytes(found.dictionary)
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = stored.groupBy("shard").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    low, high = doc_ids or (None, None)
    chosen = stored if doc_ids is None else stored.filter((F.col("last_id") >= low) & (F.col("first_id") <= high))

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress
        names = ["shard", "within", "doc_id", "n_tokens", "ids"]
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                if row["dict_hash"].as_py() != dict_hash:
                    raise ValueError("a block names another dictionary")
                counts, offsets, payload = row["n_tokens"].as_py(), row["offsets"].as_py(), row["payload"].as_py()
                starts, ids = np.cumsum([row["shard_start"].as_py(), *counts]).tolist(), row["doc_ids"].as_py()
                at = [i for i, x in enumerate(ids) if doc_ids is None or x is not None and low <= x <= high]
                for part in [at[i : i + 512] for i in range(0, len(at), 512)]:
                    plain = [np.frombuffer(expand(payload[offsets[i] : offsets[i + 1]]), f"<u{row['id_bytes'].as_py()}").astype("<u4").tobytes() for i in part]
                    columns = [pa.array([row["shard"].as_py()] * len(part), pa.int32()), pa.array([starts[i] for i in part], pa.int64()), pa.array([ids[i] for i in part], pa.int64()), pa.array([counts[i] for i in part], pa.int64()), pa.array(plain, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    # An Arrow batch of default length would hold thousands of blocks; each is handed over alone as its size allows.
    documents = mapped(chosen, inflate, "shard int, within long, doc_id long, n_tokens long, ids binary")
    # The bases are one row for each shard that one writing job made.
    return documents.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
