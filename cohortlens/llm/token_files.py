"""Token ids of whole documents in Arrow files of equal-length sequences.

A shard holds the documents of a range of ids, in ascending order, as two Arrow files:

* ``.tokens.arrow``: the shard's ids, documents joined, cut into sequences of one length. Columns
  ``ids`` (fixed-size list of unsigned integers, as narrow as the vocabulary allows) and ``mask``
  (fixed-size list of booleans, false for the padding after the last document). All record batches but
  the last have the same number of sequences, so sequence ``k`` is found by division, and reading it
  from a memory-mapped file copies nothing.
* ``.docs.arrow``: id, start within the shard and number of ids of each document.

File names carry the attempt of the task that wrote them, and only the manifest of the attempts that
succeeded names the files to read. A task that is run again, here or on another executor, so never
meets half a file.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import TwoGenerations, open_folder, text_or_empty
from cohortlens.llm.word_bpe import chunks, encoder
from cohortlens.session import cut_lineage, scratch_path

SEQUENCE_LENGTH = 2048
SEQUENCES_PER_BATCH = 64
DOCUMENTS_PER_BATCH = 4096


def id_type(vocabulary_size: int) -> np.dtype:
    return np.dtype(np.uint16 if vocabulary_size <= 1 << 16 else np.uint32)


class ShardWriter:
    """Appends documents to the two files of a shard; holds one batch of each at a time."""

    def __init__(self, folder: tuple[fs.FileSystem, str], name: str, dtype: np.dtype, length: int) -> None:
        system, path = folder
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.streams = [system.open_output_stream(f"{path}/{name}.{part}.arrow") for part in ("tokens", "docs")]
        self.tokens = ipc.new_file(self.streams[0], self.schema)
        self.docs = ipc.new_file(self.streams[1], self.index_schema)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_tokens = 0
        self.index: list[tuple] = []

    def append(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        whole = self.length * SEQUENCES_PER_BATCH
        if self.n_pending >= whole:
            joined = np.concatenate(self.pending)
            for first in range(0, len(joined) - whole + 1, whole):
                self._write(joined[first : first + whole], whole)
            rest = joined[len(joined) // whole * whole :].copy()
            self.pending, self.n_pending = [rest], len(rest)
        if len(self.index) >= DOCUMENTS_PER_BATCH:
            self._write_index()

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(part, self.length) for part in (pa.array(ids), mask)]
        self.tokens.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def _write_index(self) -> None:
        columns = [pa.array(column, pa.int64()) for column in zip(*self.index)]
        self.docs.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.index_schema))
        self.index = []

    def close(self) -> None:
        if self.n_pending:
            ids = np.concatenate(self.pending)
            padding = -len(ids) % self.length
            self._write(np.concatenate([ids, np.zeros(padding, self.dtype)]), len(ids))
        if self.index:
            self._write_index()
        for part in (self.tokens, self.docs, *self.streams):
            part.close()


class Shard:
    """A written shard. On a local or mounted folder the arrays are views of the mapped file."""

    def __init__(self, folder: tuple[fs.FileSystem, str], name: str) -> None:
        system, path = folder

        def opened(part: str) -> ipc.RecordBatchFileReader:
            file = f"{path}/{name}.{part}.arrow"
            local = isinstance(system, fs.LocalFileSystem)
            return ipc.open_file(pa.memory_map(file) if local else system.open_input_file(file))

        self.tokens, self.docs = opened("tokens"), opened("docs")
        self.length = self.tokens.schema.field("ids").type.list_size

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (without a copy) and mask of sequence ``k``."""
        batch = self.tokens.get_batch(k // SEQUENCES_PER_BATCH)
        row = slice(k % SEQUENCES_PER_BATCH * self.length, (k % SEQUENCES_PER_BATCH + 1) * self.length)
        ids, mask = (batch.column(c).flatten()[row] for c in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, start within the shard and token ids of each document."""
        whole = self.length * SEQUENCES_PER_BATCH
        held, flat = -1, None
        for b in range(self.docs.num_record_batches):
            rows = self.docs.get_batch(b)
            for doc_id, start, n in zip(*(rows.column(c).to_pylist() for c in self.index_columns)):
                parts = []
                at, end = start, start + n
                while at < end:
                    if at // whole != held:
                        held = at // whole
                        flat = self.tokens.get_batch(held).column("ids").flatten().to_numpy()
                    upto = min(end, (held + 1) * whole)
                    parts.append(flat[at - held * whole : upto - held * whole])
                    at = upto
                yield doc_id, start, parts[0] if len(parts) == 1 else np.concatenate(parts or [[]])

    index_columns = ("doc_id", "start", "n_tokens")


#: Ids of recent chunks of this worker process, by vocabulary and width; they stay from task to task.
PACKED: dict[tuple[str, str], TwoGenerations] = {}


def packed_chunks(tokenizer_path: str, code: str) -> TwoGenerations:
    """Chunk to its packed ids, held by the worker process for the last vocabulary used."""
    key = tokenizer_path, code
    if key not in PACKED:
        PACKED.clear()
        words = encoder(tokenizer_path)
        PACKED[key] = TwoGenerations(lambda chunk: array(code, words.chunk_ids(chunk)).tobytes())
    return PACKED[key]


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 1,
    length: int = SEQUENCE_LENGTH,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Write the token ids of every whole text to ``folder`` in ascending id order; the manifest.

    One shuffle, by ranges of ids; a row's place in the input breaks ties, so that many rows of one id
    can lie in several shards. The manifest has a row per shard: ``shard`` (its place in the order),
    ``name``, ``n_docs`` and ``n_tokens``. A NULL or empty text has only its end id. A NULL id comes
    first. Repeated rows are written as often as they occur. Other columns are ignored. An empty table
    writes no shard.
    """
    ordered = (
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            text_or_empty(text_column).alias("text"),
            F.monotonically_increasing_id().alias("place"),
        )
        .repartitionByRange("doc_id", "place")
        .sortWithinPartitions("doc_id", "place")
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        dtype = id_type(words.library.get_vocab_size())
        code = "H" if dtype == np.uint16 else "I"
        packed = packed_chunks(tokenizer_path, code).__getitem__
        end = array(code, [end_id]).tobytes()
        context = TaskContext.get()
        shard = context.partitionId()
        name = f"shard-{shard:06d}-{context.taskAttemptId()}"
        writer, n_docs = None, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer = writer or ShardWriter(open_folder(folder), name, dtype, length)
                writer.append(doc_id, np.frombuffer(b"".join(map(packed, chunks(text))) + end, dtype))
                n_docs += 1
        if writer:
            writer.close()
            row = {"shard": [shard], "name": [name], "n_docs": [n_docs], "n_tokens": [writer.n_tokens]}
            yield pa.RecordBatch.from_pydict(row)

    written = ordered.select("doc_id", "text").mapInArrow(
        write, "shard long, name string, n_docs long, n_tokens long"
    )
    return cut_lineage(written)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the shards: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``
    and ``ids_crc32`` of its ids as little-endian unsigned 32-bit integers.

    One task reads a shard; only the manifest, a row per shard, is summed up in order.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select(
        "shard", "name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    )
    shards = max(1, manifest.count())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, start, ids in Shard(place, name).documents():
                    rows.append((doc_id, base + start, len(ids), crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == DOCUMENTS_PER_BATCH:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return (
        placed.repartition(shards, "shard")
        .select("name", "base")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """``write_tokens`` to ``folder`` (else a new one in the shared folder), then ``read_tokens``."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer_path, folder), folder)
