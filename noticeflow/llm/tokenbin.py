"""Token-ID output: Arrow file-format files of fixed-size-list batches, for zero-copy random access."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.staging import new_dir, stage
from noticeflow.llm.tokens import encoder

_BATCH = 256  # sequences in a record batch
_MANIFEST = "file string, index_file string, first_id long, n_docs long, n_tokens long"


def _place(path: str):
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class _SequenceFile:
    """Writes ids as sequences of ``length`` ids with a mask, and an index of documents beside. A mask is ``length`` bits
    (1 token, 0 padding; the lowest of a byte first) in bytes, so that numpy can show it without a copy."""

    def __init__(self, root: str, length: int, dtype: np.dtype):
        if length % 8:
            raise ValueError("the length of a sequence must be a multiple of 8")
        self.length, self.dtype, self.width = length, dtype, length * _BATCH
        self.fs, folder = _place(root)
        self.fs.create_dir(folder, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}"
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(self.name + ".part")
        self.index_out = self.fs.open_output_stream(self.name + ".index.part")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.index_writer = pa.ipc.new_file(self.index_out, self.index_schema)
        self.held: list[np.ndarray] = []
        self.held_ids = self.total = self.docs = 0
        self.index: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, end: np.ndarray) -> None:
        n = len(ids) + len(end)
        self.index.append((doc_id, self.total, n))
        self.total += n
        self.docs += 1
        self.held += [ids, end]
        self.held_ids += n
        if self.held_ids >= self.width:
            self._write(self.held_ids // self.length * self.length)
        if len(self.index) >= 65_536:
            self._write_index()

    def _write(self, count: int) -> None:
        flat = np.concatenate([np.zeros(0, self.dtype), *self.held])
        self.held, self.held_ids = [flat[count:].copy()], len(flat) - count
        for i in range(0, count, self.width):
            part = flat[i : min(i + self.width, count)]
            self._batch(part, np.full(len(part) // 8, 255, np.uint8))

    def _batch(self, flat: np.ndarray, bits: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.FixedSizeListArray.from_arrays(pa.array(bits), self.length // 8)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def _write_index(self) -> None:
        ids, starts, counts = zip(*self.index) if self.index else ((), (), ())
        self.index_writer.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=self.index_schema))
        self.index = []

    def close(self) -> tuple[str, str]:
        self._write(self.held_ids // self.length * self.length)
        if self.held_ids:
            last = np.zeros(self.length, self.dtype)
            last[: self.held_ids] = np.concatenate(self.held)
            self._batch(last, np.packbits(np.arange(self.length) < self.held_ids, bitorder="little"))
        self._write_index()
        for x in (self.writer, self.index_writer, self.out, self.index_out):
            x.close()
        self.fs.move(self.name + ".part", self.name + ".arrow")
        self.fs.move(self.name + ".index.part", self.name + ".index.arrow")
        return self.name + ".arrow", self.name + ".index.arrow"


class SequenceReader:
    """Random access to a written file. Where the store is a local or mounted folder, ``sequence`` gives views of the
    mapped file: nothing is copied or decoded."""

    def __init__(self, root: str, name: str):
        fs, _ = _place(root)
        self.source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)

    def __len__(self) -> int:
        last = self.file.num_record_batches - 1
        return last * _BATCH + self.file.get_batch(last).num_rows if last >= 0 else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (bits in bytes; ``unpack_mask`` gives one value per id) of the i-th sequence."""
        batch, k = self.file.get_batch(i // _BATCH), i % _BATCH
        views = []
        for column in (batch.column(0), batch.column(1)):
            n = column.type.list_size
            views.append(column.flatten()[k * n : (k + 1) * n].to_numpy(zero_copy_only=True))
        return views[0], views[1]


def unpack_mask(bits: np.ndarray) -> np.ndarray:
    """A mask with one boolean per id."""
    return np.unpackbits(bits, bitorder="little").view(bool)


def write_sequences(docs: DataFrame, tokenizer: str, root: str, length: int = 2048, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` in ascending id order into files under ``root``; the manifest, one row per file.

    The rows are dealt by ranges of the id, so files follow one another in order and each task writes one. A null
    text is empty; null ids come first; repeated ids keep all their rows, next to each other. An empty table
    gives no files. An attempt of a task writes under a name of its own and names it in the manifest only when it
    is complete, so lost or repeated attempts leave unused files and no wrong rows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, first = encoder(tokenizer), None, None
        end = np.array([end_id], enc.dtype)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode_column(batch.column(1))):
                if out is None:
                    out, first = _SequenceFile(root, length, enc.dtype), key
                out.add(key, ids, end)
        if out is not None:
            name, index = out.close()
            yield pa.record_batch([pa.array([name]), pa.array([index]), pa.array([first], pa.int64()), pa.array([out.docs]), pa.array([out.total])], names=["file", "index_file", "first_id", "n_docs", "n_tokens"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stage(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame, root: str) -> DataFrame:
    """Read the files of a manifest back: doc_id, start, n_tokens, ids_crc32 of every document.

    start counts the ids of all documents before; the sums before each file run over the manifest, which has one
    row per file. Ids are taken from the stored sequences where the mask is set.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_file(root, row["file"], row["index_file"], row["before"])

    spark = manifest.sparkSession
    from pyspark.sql import Window

    order = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    dealt = placed.repartition(max(1, manifest.count()), "file")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _stored_ids(root: str, name: str) -> Iterator[np.ndarray]:
    """Ids of a file where the mask is set, batch by batch."""
    fs, _ = _place(root)
    with fs.open_input_file(name) as f:
        file = pa.ipc.open_file(f)
        for i in range(file.num_record_batches):
            batch = file.get_batch(i)
            ids, bits = (batch.column(k).flatten().to_numpy(zero_copy_only=True) for k in (0, 1))
            yield ids if (bits == 255).all() else ids[unpack_mask(bits)]


def _read_file(root: str, name: str, index_name: str, before: int) -> Iterator[pa.RecordBatch]:
    stored, held = _stored_ids(root, name), np.zeros(0, "<u4")
    fs, _ = _place(root)
    with fs.open_input_file(index_name) as f:
        index = pa.ipc.open_file(f)
        for i in range(index.num_record_batches):
            part = index.get_batch(i)
            crcs = []
            for n in part.column(2).to_numpy().tolist():
                crc, left = 0, n
                while left:
                    if not len(held):
                        held = next(stored)
                    crc = zlib.crc32(held[:left].astype("<u4").tobytes(), crc)
                    left, held = left - min(left, len(held)), held[left:]
                crcs.append(crc)
            starts = part.column(1).to_numpy() + before
            yield pa.record_batch([part.column(0), pa.array(starts), part.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared store and read the documents back from the files."""
    root = new_dir(docs.sparkSession, "sequences")
    return read_documents(write_sequences(docs, tokenizer, root, length, end_id), root)
