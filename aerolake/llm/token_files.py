"""Token ids in Arrow files of equal-length sequences, written and read by Spark tasks.

Layout. Texts are encoded, each followed by an end id, and laid end to end in ascending doc_id (null ids first, ties by the
text's hash); each task packs its run into sequences of ``length`` ids. A file is an Arrow stream with a footer (the IPC
file format): record batches of two fixed-size-list columns, ``ids`` (16 bits if the vocabulary allows, else 32) and
``mask`` (true where there is an id, false where the last sequence is padded). Beside it lies ``<name>.docs``, the same
format with (doc_id, n_tokens) in order. Both are uncompressed, so ``TokenFile`` maps a file and slices any sequence or
document without copying. A task writes under a name of its own; only files named in the manifest of finished tasks count,
so retried and speculative tasks do no harm.

Defined cases: null text is empty and gives the end id alone; very long texts are encoded whole; equal rows are all written; an empty table gives no file and
no row; further columns of the input play no part.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.llm.common import materialise, new_folder, read_table, slices, text_or_empty, worker_state
from aerolake.llm.units import Memo, cut

TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 2
LENGTH = 1024
#: Sequences of a record batch.
BATCH_SEQUENCES = 256
#: Bytes of a generation of a worker's memo of words; a bound on memory only.
MEMO_BYTES = 128 << 20

MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


class LibraryEncoder:
    """``tokenizers`` on whole texts. Its pattern cuts at single spaces and newlines, so the library encodes each unit once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.memo = Memo(MEMO_BYTES)
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of units by one call on a text of a unit a line; a newline between two words is a token of its own."""
        if any(u.isspace() for u in units):
            return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(units)], add_special_tokens=False)[0].ids, np.int32)
        ends = [*(np.flatnonzero(ids == self.newline) * 4).tolist(), 4 * len(ids)]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        units = None if any(t in text for t in self.added) else cut(text)
        if units is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32).tobytes()
        return b"".join(self.memo.many(units, self._units))


class TokenFileWriter:
    """Packs ids into sequences of equal length and writes both files of a part."""

    def __init__(self, uri: str, length: int, wide: bool, id_type: pa.DataType):
        self.fs, path = pa.fs.FileSystem.from_uri(uri)
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        self.length, self.dtype = length, np.uint32 if wide else np.uint16
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.docs_sink = self.fs.open_output_stream(path + ".docs")
        self.docs_schema = pa.schema([("doc_id", id_type), ("n_tokens", pa.int64())])
        self.docs = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.rest = np.empty(0, self.dtype)
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, counts: list[int], ids: np.ndarray) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64())], schema=self.docs_schema))
        self.n_docs += len(counts)
        self.n_tokens += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(self.dtype)])
        step = self.length * BATCH_SEQUENCES
        while len(self.rest) >= step:
            self._write(self.rest[:step])
            self.rest = self.rest[step:]

    def _write(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.length) * self.length
        mask = np.zeros(n, bool)
        mask[: len(ids)] = True
        full = np.zeros(n, self.dtype)
        full[: len(ids)] = ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            self._write(self.rest)
        for x in (self.out, self.sink, self.docs, self.docs_sink):
            x.close()


class TokenFile:
    """Random access to a part: ``sequence(i)`` and ``document(k)`` without copying where the file system can map files."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file
        self.reader = pa.ipc.open_file(opened(path))
        self.length = self.reader.schema.field("ids").type.list_size
        docs = pa.ipc.open_file(opened(path + ".docs")).read_all()
        self.doc_ids = docs.column("doc_id")
        self.ends = np.cumsum(docs.column("n_tokens").to_numpy())

    def _batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.reader.get_batch(k)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        ids, mask = self._batch(i // BATCH_SEQUENCES)
        at = i % BATCH_SEQUENCES * self.length
        return ids[at : at + self.length], mask.slice(at, self.length).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the part, a view if one batch holds them."""
        step, parts = self.length * BATCH_SEQUENCES, []
        while start < end:
            k = start // step
            stop = min(end, (k + 1) * step)
            parts.append(self._batch(k)[0][start - k * step : stop - k * step])
            start = stop
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Write all texts of (doc_id, text) below ``folder``; returns the manifest (file, part, n_docs, n_tokens), itself materialised."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")

    def run(batches):
        writer = encoder = uri = None
        part = TaskContext.get().partitionId()
        path = tokenizer_path or default_tokenizer_path()
        for batch in (part_of for whole in batches for part_of in slices(whole)):
            if writer is None:
                encoder = worker_state(("token files", path), lambda: LibraryEncoder(path))
                uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
                writer = TokenFileWriter(uri, length, max(encoder.n_ids, end_id + 1) > 1 << 16, batch.schema.field(0).type)
            end = np.int32(end_id).tobytes()
            found = [encoder.encode(text.as_py()) + end for text in batch.column(1)]
            writer.add(batch.column(0), [len(x) // 4 for x in found], np.frombuffer(b"".join(found), np.int32))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([part], pa.int32()), pa.array([writer.n_docs]), pa.array([writer.n_tokens])], names=MANIFEST.names)

    return materialise(rows.mapInArrow(run, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """Every document of the written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", "part", before.alias("base"))  # a row a file
    files = files.repartitionByRange(max(1, manifest.count()), "part")  # a task a file: a number that is given is not coalesced
    schema = T.StructType([T.StructField("doc_id", id_type or T.LongType()), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                file = TokenFile(uri)
                n = len(file.ends)
                for k in range(0, n, 4096):
                    ends = file.ends[k : k + 4096]
                    starts = np.concatenate([[file.ends[k - 1] if k else 0], ends[:-1]])
                    crcs = [zlib.crc32(file.tokens(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([file.doc_ids.slice(k, 4096).combine_chunks(), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())], names=schema.names)

    return files.mapInArrow(run, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return read_documents(write(docs, new_folder(spark, "token-files")), docs.schema["doc_id"].dataType)


QUERIES = {"op6_token_files": op6_token_files}
