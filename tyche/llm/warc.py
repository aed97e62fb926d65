"""WARC archives with revisit records and a two-level capture index.

An archive is a stream of gzip members, one per record, as in ``.warc.gz`` files; it is stored in chunks of about a
megabyte, rows of a Parquet table (``archive``, ``chunk``, ``bytes``), so that any store that Spark writes can hold
it and a reader fetches one chunk. Written in order, the chunks of an archive are a valid ``.warc.gz`` file.

The index sorts captures by their key (host labels reversed, then path; then page_id) into compressed blocks. Its
sparse directory has one row per block: the first and last key. A lookup bisects the directory for the blocks of its
keys, bisects the lines of each block, and cuts the named range out of the named chunk (Spark reads a chunk whole).
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, mapped
from .token_counts import balanced

#: Smallest payload in bytes that a revisit may stand for.
REVISIT_BYTES = 1000
#: Digests with copies up to this number (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
CHUNK_BYTES = 1 << 20
#: Lines of an index block, and the blocks of an index at most: beyond, blocks get more lines. So a directory may be broadcast.
BLOCK_LINES, MOST_BLOCKS = 3000, 500_000
CHUNKS = "archive int, chunk int, keys array<string>, page_ids array<long>, starts array<int>, sizes array<int>, bytes binary"
BLOCKS = "shard int, block int, first_key string, last_key string, lines binary"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
#: The tables hold no time of capture.
DATE = "1970-01-01T00:00:00Z"


def capture_key(url: str | None) -> str:
    """``com,example,www)/path?query`` in lower case, without scheme, port and fragment; as given if it has no host."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        host = None
    if not host:
        return " ".join((url or "").split())
    path = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + " ".join(path.lower().split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit has no body. Header values are kept on one line."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", "" if url is None else url.encode("unicode_escape").decode("ascii")), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html"), ("Content-Length", str(len(body))),
    ]
    if url is None:
        fields = [f for f in fields if f[0] != "WARC-Target-URI"]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode("ascii") + body + b"\r\n\r\n", 4, mtime=0)


def parsed(member: bytes) -> tuple:
    """The row of ``RECORD`` that a gzip member holds; lengths and digest of a response are checked."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    lines = head.decode("ascii").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda text: int(n) if (n := text.removeprefix("<urn:page:").removesuffix(">")) else None
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    if rest[len(body) :] != b"\r\n\r\n" or not revisit and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError("a record does not match its header")
    url = fields.get("WARC-Target-URI")
    url = None if url is None else url.encode("ascii").decode("unicode_escape")
    return number(fields["WARC-Record-ID"]), url, fields["WARC-Type"], size, digest, number(fields["WARC-Refers-To"]) if revisit else None, None if revisit else body.decode("utf-8")


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes one record for each row of ``pages`` (``page_id``, ``url``, ``html``), then the capture index.

    Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the largest page_id is a response
    and the others revisit it; repeated rows of that page are responses each. A null html is an empty payload. A page
    without id is a revisit where another has the payload, and a response where none has an id. A null url has the
    empty key. Other columns are not read; an empty table gives empty archives.
    """
    read = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    read = read.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    groups = read.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    copies = kept(groups.filter("n > 1 and original is not null").select("digest", "original"), "copies")
    few = copies.count() <= BROADCAST_DIGESTS
    original = F.when((F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    joined = read.join(F.broadcast(copies) if few else copies, "digest", "left").select("page_id", "url", "html", "digest", original.alias("refers_to"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, number, size = TaskContext.get().partitionId(), 0, 0
        keys: list[str] = []
        ids: list = []
        members: list[bytes] = []

        def chunk() -> pa.RecordBatch:
            sizes = [len(m) for m in members]
            starts = [0, *accumulate(sizes)][:-1]
            values = [archive, number, keys, ids, starts, sizes, b"".join(members)]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["archive", "chunk", "keys", "page_ids", "starts", "sizes", "bytes"])

        for batch in balanced(batches, 2):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members.append(record(page_id, url, html.encode("utf-8"), digest, refers_to))
                keys.append(capture_key(url))
                ids.append(page_id)
                size += len(members[-1])
                if size >= CHUNK_BYTES:
                    yield chunk()
                    keys, ids, members, size, number = [], [], [], 0, number + 1
        if members:
            yield chunk()

    mapped(joined, chunks, CHUNKS).write.option("compression", "none").parquet(f"{path}/archives")

    stored = pages.sparkSession.read.schema(CHUNKS).parquet(f"{path}/archives")
    block_lines = max(BLOCK_LINES, -(-(stored.agg(F.sum(F.size("page_ids"))).first()[0] or 0) // MOST_BLOCKS))
    captures = stored.select("archive", "chunk", F.explode(F.arrays_zip("keys", "page_ids", "starts", "sizes")).alias("c"))
    captures = captures.select(F.col("c.keys").alias("key"), F.col("c.page_ids").alias("page_id"), "archive", "chunk", F.col("c.starts").alias("start"), F.col("c.sizes").alias("size"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        lines: list[tuple] = []

        def block() -> pa.RecordBatch:
            text = "\n".join("\t".join("" if v is None else str(v).replace("\t", " ") for v in line) for line in lines)
            values = [shard, number, lines[0][0], lines[-1][0], zlib.compress(text.encode("utf-8"))]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["shard", "block", "first_key", "last_key", "lines"])

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(line)
                if len(lines) >= block_lines:
                    yield block()
                    lines, number = [], number + 1
        if lines:
            yield block()

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    mapped(ordered, blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/index")
    index = pages.sparkSession.read.schema(BLOCKS).parquet(f"{path}/index")
    index.select("first_key", "last_key", "shard", "block").write.parquet(f"{path}/directory")


LINE = "key string, page_id long, archive int, chunk int, start int, size int"


def index_lines(blocks: DataFrame, some: bool = False) -> DataFrame:
    """The lines of index blocks; with ``some``, only those of the keys in a block's column ``wanted``, by bisection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, wanted in zip(batch.column(0), batch.column(1), strict=True):
                lines = [line.split("\t") for line in zlib.decompress(packed.as_py()).decode("utf-8").split("\n")]
                if some:
                    keys = [line[0] for line in lines]
                    ranges = [(bisect_left(keys, key), bisect_right(keys, key)) for key in sorted(wanted.as_py())]
                    lines = [line for first, stop in ranges for line in lines[first:stop]]
                columns = list(zip(*lines, strict=True)) or [()] * 6
                numbers = [pa.array([int(v) if v else None for v in c], k) for c, k in zip(columns[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *numbers], [f.split()[0] for f in LINE.split(", ")])

    return mapped(blocks.select("lines", "wanted" if some else F.lit(None).cast("array<string>")), run, LINE)


def read_captures(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """The records that index lines name: ranges of one chunk are read together, each chunk once."""
    ranges = lines.groupBy("archive", "chunk").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("ranges"))  # at most a chunk's records
    stored = spark.read.schema(CHUNKS).parquet(f"{path}/archives").select("archive", "chunk", "bytes")
    wanted = stored.join(ranges, ["archive", "chunk"]).select("ranges", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for ranges, data in zip(batch.column(0), batch.column(1), strict=True):
                whole = data.as_buffer().to_pybytes()
                rows = [parsed(whole[r["start"] : r["start"] + r["size"]]) for r in ranges.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return mapped(wanted, run, RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records, by all lines of the index."""
    return read_captures(spark, path, index_lines(spark.read.schema(BLOCKS).parquet(f"{path}/index")))


def lookup(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """The records whose keys are those of ``urls(url)``, each once: directory, then blocks, then ranges.

    A null url has the empty key; repeated urls, and urls of one key, are one; an unknown key has no record; an empty
    table gives an empty result.
    """
    directory = spark.read.parquet(f"{path}/directory").orderBy("shard", "block").collect()  # MOST_BLOCKS rows, about
    known = spark.sparkContext.broadcast(([r.first_key for r in directory], [r.last_key for r in directory], [(r.shard, r.block) for r in directory]))

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, places = known.value
        for batch in batches:
            found: list[tuple] = []
            for key in {capture_key(url) for url in batch.column(0).to_pylist()}:
                at = bisect_left(lasts, key)
                while at < len(firsts) and firsts[at] <= key:
                    found.append((*places[at], key))
                    at += 1
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string()), strict=True)], ["shard", "block", "key"])

    near = mapped(urls.select("url").distinct(), blocks_of, "shard int, block int, key string")
    wanted = near.groupBy("shard", "block").agg(F.collect_set("key").alias("wanted"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/index").join(wanted, ["shard", "block"])
    return read_captures(spark, path, index_lines(blocks, some=True))
