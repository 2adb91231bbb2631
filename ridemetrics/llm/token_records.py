"""Token ids as length-delimited binary records.

A record file is a run of frames:

    8 bytes   length of the payload, little-endian
    4 bytes   masked CRC-32 of those 8 bytes
    n bytes   payload
    4 bytes   masked CRC-32 of the payload

A payload is one document: 1 byte width of an id (2 or 4), 1 byte whether the
document has a doc_id, 8 bytes doc_id, then the ids, all little-endian. A frame
without payload ends a block of about `block_bytes`; a file is some blocks. The
mask (rotate by 15 bits and add a constant) keeps the checksum of data that holds
checksums apart from them.

Documents are range-partitioned by id, so files in the order of their names
(shard, then number within it) hold them in ascending order. Spark's own file
sink writes them, so a lost executor leaves no half-written file behind, and any
store Spark can write will do. The offset index is a table of its own beside the
files: a shuffled read permutes the index and takes each record at its offset.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridemetrics.llm.common import NULL_ID, keyed, public_id
from ridemetrics.llm.packing import worker_tokenizer

END_ID = 1
#: Bytes of frames in a block, and blocks in a file: a file read whole is some 16 MB.
BLOCK_BYTES = 4 << 20
FILE_BLOCKS = 4

_MASK_DELTA = 0xA282EAD8
_HEAD = "<BBq"


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


END_BLOCK = frame(b"")


def frames(content: bytes, name: str) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of each record of a file; ValueError where it is damaged."""
    view, at = memoryview(content), 0
    while at < len(view):
        if at + 12 > len(view):
            raise ValueError(f"{name}: cut short at byte {at}")
        length, check = struct.unpack_from("<QI", view, at)
        if masked_crc(view[at : at + 8]) != check:
            raise ValueError(f"{name}: bad length at byte {at}")
        stop = at + 12 + length
        if stop + 4 > len(view):
            raise ValueError(f"{name}: cut short at byte {at}")
        payload = view[at + 12 : stop]
        if masked_crc(payload) != struct.unpack_from("<I", view, stop)[0]:
            raise ValueError(f"{name}: bad record at byte {at}")
        if length:
            yield at, payload
        at = stop + 4


def payload_of(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    known = doc_id != NULL_ID
    return struct.pack(_HEAD, width, known, doc_id if known else 0) + ids.astype(f"<u{width}").tobytes()


def ids_of(payload: memoryview) -> tuple[int, np.ndarray]:
    """doc_id (NULL_ID for none) and ids, unsigned 32-bit, of a record."""
    width, known, doc_id = struct.unpack_from(_HEAD, payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_HEAD)).astype("<u4")
    return doc_id if known else NULL_ID, ids


def _framer(tokenizer_path: str, end_id: int, block_bytes: int):
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(tokenizer_path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        held: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            value = pa.array([b"".join(held)], pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([value], ["value"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.frombuffer(encoder.encode(text.as_py()), "<u4")
                held.append(frame(payload_of(doc_id, np.concatenate([ids, end]), width)))
                size += len(held[-1])
                if size >= block_bytes:
                    yield block()
                    size = 0
        if held:
            yield block()

    return run


def write_records(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    block_bytes: int = BLOCK_BYTES,
    file_blocks: int = FILE_BLOCKS,
) -> None:
    """Write `docs` as records to `path`/records and their offset index to `path`/index.

    One record per row, its ids and then `end_id`; a NULL or empty text is that
    one id. Records ascend by doc_id, NULL first; rows that share an id ascend
    by a hash of their text, and equal rows are a record each. An empty table
    gives no record. Ids take 2 bytes if the vocabulary allows it. `path` must
    not exist yet.
    """
    # Equal rows may be cut between partitions anywhere, hence the last key.
    rows = keyed(docs, id_col, text_col).withColumn("tie", F.monotonically_increasing_id())
    order = ["doc_id", "row_hash", "tie"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = ordered.mapInArrow(_framer(tokenizer_path, end_id, block_bytes), "value binary")
    # The text sink writes a string's bytes as they are, and after each row the
    # separator: here the frame that ends a block, spelt in a charset of bytes.
    (
        blocks.select(F.col("value").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", END_BLOCK.decode("latin-1"))
        .option("compression", "none")
        .option("maxRecordsPerFile", file_blocks)
        .text(f"{path}/records")
    )
    entries = _files(docs.sparkSession, path).mapInArrow(_list_records, _ENTRY)
    entries.write.parquet(f"{path}/index")


_ENTRY = "shard long, file long, offset long, length long, doc_id long, first long, n_tokens long"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """shard, file, name, content of every record file."""
    name = F.element_at(F.split("path", "/"), -1)
    pattern = r"part-(\d+)-.*-c(\d+)\."
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(f"{path}/records")
        .select(
            F.regexp_extract(name, pattern, 1).cast("long").alias("shard"),
            F.regexp_extract(name, pattern, 2).cast("long").alias("file"),
            name.alias("name"),
            "content",
        )
    )


def _each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, bytes, int]]:
    """shard, file, name, content, and where in its batch, one file at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, file, name, content = (batch.column(c)[i].as_py() for c in ("shard", "file", "name", "content"))
            yield shard, file, name, content, i


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names = [column.split()[0] for column in ddl.split(", ")]
    numbers = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in numbers.T], names)


def _list_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries; `first` counts the ids before the record in its file."""
    for shard, file, name, content, _ in _each_file(batches):
        rows, first = [], 0
        for offset, payload in frames(content, name):
            doc_id, ids = ids_of(payload)
            rows.append((shard, file, offset, len(payload), doc_id, first, len(ids)))
            first += len(ids)
        yield _table(rows, _ENTRY)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index: shard, file, offset, length, doc_id, start, n_tokens.

    `start` counts the ids of all records before this one. Its sums run over
    files within a shard, and over shards, of which there are as many as the
    write had partitions.
    """
    index = spark.read.schema(_ENTRY).parquet(f"{path}/index")
    return _with_starts(index, index).select(
        "shard", "file", "offset", "length", public_id(), (F.col("file_start") + F.col("first")).alias("start"), "n_tokens"
    )


def _with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    files = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    shards = files.groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", "file", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("start"))
    starts = files.join(shards, "shard").select(
        "shard", "file", (F.col("shard_start") + F.col("start")).alias("file_start")
    )
    return records.join(starts, ["shard", "file"])


_DIGEST = "shard long, file long, doc_id long, first long, n_tokens long, ids_crc32 long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, file, name, content, _ in _each_file(batches):
        rows, first = [], 0
        for _, payload in frames(content, name):
            doc_id, ids = ids_of(payload)
            rows.append((shard, file, doc_id, first, len(ids), zlib.crc32(ids)))
            first += len(ids)
        yield _table(rows, _DIGEST)


def record_digests(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens, ids_crc32 of each record.

    The checksum is of the ids as 32-bit integers, whatever their width in the file.
    """
    read = _files(spark, path).mapInArrow(_digests, _DIGEST)
    index = spark.read.schema(_ENTRY).parquet(f"{path}/index")
    return _with_starts(read, index).select(
        public_id(), (F.col("file_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records named by a file's `wanted` entries, each found at its offset."""
    for batch in batches:
        for _, _, name, content, i in _each_file([batch]):
            wanted = batch.column("wanted")[i].as_py()
            view = memoryview(content)
            ids, rows = [], []
            for entry in wanted:
                stop = entry["offset"] + 12 + entry["length"] + 4
                ((_, payload),) = frames(view[entry["offset"] : stop], name)
                doc_id, own = ids_of(payload)
                rows.append((entry["place"], doc_id))
                ids.append(own.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                ["place", "doc_id", "ids"],
            )


def read_shuffled(spark: SparkSession, path: str, seed: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Records in an order drawn from `seed`: place, doc_id, ids.

    `place` orders the rows. Of `parts` readers each gets a share of its own of
    the permuted index; only the files that hold records of the share are opened.
    The order depends on seed, shard, file and offset alone, so it can be repeated.
    """
    index = spark.read.schema(_ENTRY).parquet(f"{path}/index")
    place = F.xxhash64(F.lit(seed), "shard", "file", "offset")
    share = index.withColumn("place", place).filter(F.pmod("place", F.lit(parts)) == part)
    # A file is bounded, and with it the entries that meet here.
    wanted = share.groupBy("shard", "file").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "place"))).alias("wanted")
    )
    taken = (
        _files(spark, path)
        .join(wanted, ["shard", "file"])
        .mapInArrow(_take, "place long, doc_id long, ids array<long>")
    )
    return taken.withColumn("doc_id", public_id()).orderBy("place")
