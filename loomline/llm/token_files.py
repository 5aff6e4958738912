"""Token ids in files: Arrow streams of sequences of one length, with masks, that are read in place.

A folder holds shards. ``<name>.ids`` is an Arrow stream whose batches have the same number of rows but for the last, each row a fixed-size list of ids and
one of a mask, a bit for each place (1: an id, 0: filling at a shard's end). All batches take the same number of bytes, so the place of any sequence in the file follows from its
number: a reader maps the file, or reads one range of it, and sees ids and masks without decoding or copying. Documents follow each other without gaps, across
sequences. ``<name>.docs`` is an Arrow stream with the identifier, start and length of each document, in order. The Parquet table ``shards`` lists the
shards that count, in order, with the number of ids before each.

Tasks write shards under names of their own; the table is written, by Spark, from what the finished tasks say. What a lost or repeated
task has left is in no table and is deleted at the end.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import need_columns, new_path, ship, text_or_empty, written
from .tokens import public_tokenizer, word_bpe
from .warc import file_system

#: Ids of a sequence, and sequences of a batch.
LENGTH, BATCH = 2048, 64
#: Bytes of ids that a reading task hands on together, unless a document alone has more.
HANDED_ON = 4 << 20
SHARD = "number int, name string, documents long, tokens long, sequences long"


def _sequences(length: int, width: int, batch: int) -> pa.Schema:
    kind = {2: pa.uint16(), 4: pa.uint32()}[width]
    return pa.schema([pa.field("ids", pa.list_(kind, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)], {"sequences": str(batch)})


class ShardWriter:
    """One shard: documents in, full batches out; an unfinished batch and the documents' places since the last one are all that is held."""

    def __init__(self, system: fs.FileSystem, path: str, id_type: pa.DataType, length: int, batch: int, width: int):
        self.schema, self.width = _sequences(length, width, batch), width
        self.docs_schema = pa.schema([("id", id_type), ("start", pa.int64()), ("length", pa.int64())])
        self.files = [system.open_output_stream(f"{path}.{kind}", compression=None) for kind in ("ids", "docs")]
        self.ids_out, self.docs_out = (pa.ipc.new_stream(f, s) for f, s in zip(self.files, (self.schema, self.docs_schema), strict=True))
        self.length, self.room = length, length * batch
        self.held, self.docs = np.zeros(self.room, f"<u{width}"), ([], array("q"), array("q"))
        self.used = self.tokens = self.documents = self.sequences = 0

    def add(self, identifier, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"an id does not fit {self.width} bytes")
        for column, value in zip(self.docs, (identifier, self.tokens, len(ids)), strict=True):
            column.append(value)
        self.tokens += len(ids)
        self.documents += 1
        at = 0
        while at < len(ids):
            n = min(self.room - self.used, len(ids) - at)
            self.held[self.used : self.used + n] = ids[at : at + n]
            self.used, at = self.used + n, at + n
            if self.used == self.room:
                self._flush()
        if len(self.docs[0]) == 10_000:
            self._flush_docs()

    def _flush(self) -> None:
        rows = -(-self.used // self.length)
        self.held[self.used :] = 0
        mask = np.zeros(rows * self.length, bool)
        mask[: self.used] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(values), type=f.type) for values, f in zip((self.held[: rows * self.length], mask), self.schema, strict=True)]
        self.ids_out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.sequences, self.used = self.sequences + rows, 0

    def _flush_docs(self) -> None:
        identifiers, starts, lengths = self.docs
        self.docs_out.write_batch(pa.RecordBatch.from_arrays([pa.array(identifiers, self.docs_schema.field(0).type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], schema=self.docs_schema))
        self.docs = ([], array("q"), array("q"))

    def close(self) -> None:
        if self.used:
            self._flush()
        if self.docs[0]:
            self._flush_docs()
        for x in (self.ids_out, self.docs_out, *self.files):
            x.close()


class TokenFile:
    """Random access to the sequences of a shard; on a local file system the arrays lie in the mapped file, read-only and uncopied."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.system, self.path = system, path
        local = isinstance(system, fs.LocalFileSystem)
        self.file = pa.memory_map(path, "r") if local else system.open_input_file(path)
        self.size = self.file.size()
        stream = pa.ipc.open_stream(self.file)
        self.schema, self.first = stream.schema, self.file.tell()
        self.length, self.batch = self.schema.field("ids").type.list_size, int(self.schema.metadata[b"sequences"])
        try:
            self.file.seek(self.first)
            pa.ipc.read_message(self.file)
            self.step = self.file.tell() - self.first
        except EOFError:  # no batch at all
            self.step = 1
        self.held: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, number: int) -> pa.RecordBatch:
        """By its place: all batches before it take equally many bytes."""
        if self.held is None or self.held[0] != number:
            at = self.first + number * self.step
            if number < 0 or at >= self.size:
                raise IndexError(f"batch {number} of {self.path}")
            self.file.seek(at)
            try:
                self.held = number, pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
            except EOFError:
                raise IndexError(f"batch {number} of {self.path}") from None
        return self.held[1]

    def sequence(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of a sequence, as views: the mask's bits stay bits."""
        b, row = self._batch(number // self.batch), number % self.batch
        if number < 0 or row >= b.num_rows:
            raise IndexError(f"sequence {number} of {self.path}")
        at = row * self.length
        return b.column(0).flatten().to_numpy(zero_copy_only=True)[at : at + self.length], b.column(1).flatten().slice(at, self.length)

    def ids(self, start: int, length: int) -> Iterator[np.ndarray]:
        """The ids from a place on, as views, one for each batch that they lie in."""
        room = self.batch * self.length
        while length:
            b, at = self._batch(start // room), start % room
            part = b.column(0).flatten().to_numpy(zero_copy_only=True)[at : at + length]
            if not len(part):
                raise IndexError(f"id {start} of {self.path}")
            yield part
            start, length = start + len(part), length - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        with self.system.open_input_stream(f"{self.path.removesuffix('.ids')}.docs", compression=None) as f:
            yield from pa.ipc.open_stream(f)

    def close(self) -> None:
        self.held = None
        self.file.close()


@contextmanager
def one_thread() -> Iterator[None]:
    """The tokenizers library without threads of its own: every core has a task already."""
    name, before = "TOKENIZERS_PARALLELISM", os.environ.get("TOKENIZERS_PARALLELISM")
    os.environ[name] = "false"
    try:
        yield
    finally:
        os.environ.pop(name) if before is None else os.environ.__setitem__(name, before)


def id_bytes(tokenizer: str, end: int | None) -> int:
    """Two bytes for each id if all ids of a tokenizer fit, else four."""
    from tokenizers import Tokenizer

    most = max([*Tokenizer.from_file(tokenizer).get_vocab().values(), end or 0])
    return 2 if most < 1 << 16 else 4


def write_tokens(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 1, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Writes the ids of all whole texts, each followed by ``end``, in ascending order of id_col, into a new folder; gives the table of shards.

    df: id_col (integer, text or the like) and text_col are read, other columns may have any name. Null texts count as empty, and are ``end`` alone, or nothing without
    an end. Null ids come first; rows of one id are ordered by a hash of their text, rows alike in both are interchangeable, and all are written. A folder that is there
    already is an error; an empty table is a folder without shards. Texts are sorted in ranges, a shard for each; within a range Spark's sort spills.
    """
    need_columns(df, id_col, text_col)
    spark = df.sparkSession
    ship(spark)
    system, folder = file_system(path)
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(folder)
    if length < 1 or batch < 1:
        raise ValueError("a sequence has one id at least, a batch one sequence")
    width = id_bytes(tokenizer, end)
    last = np.array([] if end is None else [end], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, place = file_system(path)
        cache, shard, name, number = word_bpe(tokenizer), None, uuid.uuid4().hex, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                with one_thread():
                    encoded = cache.ids(b.column(1).to_pylist())
                for i, r, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), encoded, strict=True):
                    if shard is None:
                        shard, number = ShardWriter(target, f"{place}/{name}", b.column(0).type, length, batch, width), r
                    shard.add(i, np.frombuffer(ids + last, "<u4"))
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((number, pa.int32()), (name, pa.string()), (shard.documents, pa.int64()), (shard.tokens, pa.int64()), (shard.sequences, pa.int64()))], ["number", "name", "documents", "tokens", "sequences"])

    order = [F.col("_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    texts = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row")).withColumn("_hash", F.xxhash64("_text"))
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text", F.spark_partition_id().alias("_range"))
    shards = written(ranged.mapInArrow(work, SHARD), "shards")
    before = F.sum("tokens").over(W.orderBy("number").rowsBetween(W.unboundedPreceding, -1))  # a row for each shard
    shards.withColumn("start", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/shards")
    kept = {r["name"] for r in shards.select("name").collect()}
    for x in system.get_file_info(fs.FileSelector(folder)):
        if x.is_file and x.base_name.rpartition(".")[0] not in kept:
            system.delete_file(x.path)
    return spark.read.parquet(f"{path}/shards")


def _by_shard(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The rows of the table of shards, each in a task of its own."""
    shards = spark.read.parquet(f"{path}/shards").select("name", *columns)
    return shards.repartition(max(1, shards.count()))  # dealt in turn from the one file of the table


def read_documents(spark: SparkSession, path: str, id_type: str = "long", digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the shards: start is the number of ids before it in the whole folder, ids are little-endian unsigned 32-bit numbers.

    id_type: the type of the ids that were written. digest: instead of ids, ids_crc32, the unsigned CRC-32 of these bytes, worked out where they are read.
    """
    ship(spark)
    name, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())

    def batch(rows: list[tuple], of_id: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (of_id, pa.int64(), pa.int64(), kind), strict=True)], ["id", "start", "n_tokens", name])

    def value(parts: Iterator[np.ndarray]) -> int | bytes:
        if not digest:
            return b"".join(p.astype("<u4").tobytes() for p in parts)
        crc = 0
        for p in parts:
            crc = zlib.crc32(p.astype("<u4"), crc)
        return crc

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(path)
        for b in batches:
            for shard_name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = TokenFile(system, f"{folder}/{shard_name}.ids")
                for docs in shard.documents():
                    rows, held = [], 0
                    for i, start, length in zip(*(docs.column(c).to_pylist() for c in range(3)), strict=True):
                        rows.append((i, before + start, length, value(shard.ids(start, length))))
                        held += 0 if digest else 4 * length
                        if held > HANDED_ON:
                            yield batch(rows, docs.schema.field(0).type)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows, docs.schema.field(0).type)
                shard.close()

    return _by_shard(spark, path, "start").mapInArrow(work, f"id {id_type}, start long, n_tokens long, {name} {'long' if digest else 'binary'}")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(shard, sequence, ids, mask): all sequences as a trainer takes them; shard is its place in the order of shards, sequence that in the shard."""
    ship(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(path)
        for b in batches:
            for name, number, sequences in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = TokenFile(system, f"{folder}/{name}.ids")
                for at in range(0, sequences, shard.batch):
                    ids, mask = zip(*(shard.sequence(i) for i in range(at, min(sequences, at + shard.batch))), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(ids), pa.int32()), pa.array(range(at, at + len(ids)), pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([x.to_pylist() for x in mask], pa.list_(pa.bool_()))],
                        ["shard", "sequence", "ids", "mask"],
                    )
                shard.close()

    return _by_shard(spark, path, "number", "sequences").mapInArrow(work, "shard int, sequence long, ids array<int>, mask array<boolean>")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the ids of all documents, written and read back."""
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizer("word_bpe_49k.json"))
    return read_documents(spark, path, digest=True).withColumnRenamed("id", "doc_id")
