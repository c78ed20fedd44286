"""Token files with bit-plane shuffled, zstd-compressed blocks and a chunk index.

File layout (little-endian):

    magic ``LBPF``, u32 version, u32 ids per block
    for each block: its non-zero bit planes, lowest bit first, each compressed
    footer (zstd): the document index and the chunk index
    u64 place of the footer, u64 its length, magic

A block of n ids is a 32 x n bit matrix; row p (bit p of every id) is packed to
ceil(n / 8) bytes and compressed alone.  Planes of zeros are left out; the
chunk index holds, for each block, its place, its number of ids and the length
of each of its 32 planes (0: zeros).  The document index holds doc_id, a NULL
mark and the number of ids of each document, in file order.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.runtime import shared_dir, ship
from limnos.llm.tokens import encoder, read_tokenizer

MAGIC, VERSION, PLANES = b"LBPF", 1, 32


# ------------------------------------------------------------ one file

def split_planes(ids: np.ndarray) -> list[bytes]:
    """Bit planes of a block of ids; a plane of zeros is empty."""
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    used = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    return [np.packbits(bits[:, p]).tobytes() if used >> p & 1 else b"" for p in range(PLANES)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for p, data in enumerate(planes):
        if data:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n)
            out |= bits.astype(np.uint32) << np.uint32(p)
    return out


class PlaneWriter:
    """Append documents to a stream; at most one block of ids is held besides the indexes."""

    def __init__(self, stream, block: int = 65536, level: int = 1):
        self.stream, self.block = stream, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held, self.size = [], 0
        self.docs, self.chunks = [], []
        self.place = 0
        self._write(MAGIC + struct.pack("<II", VERSION, block))

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for lo in range(0, whole, self.block):
                self._chunk(flat[lo:lo + self.block])
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) if p else b"" for p in split_planes(ids)]
        self.chunks.append((self.place, len(ids), *map(len, planes)))
        self._write(b"".join(planes))

    def close(self) -> int:
        """Write what is left and the indexes; returns the number of ids."""
        if self.size:
            self._chunk(np.concatenate(self.held))
        docs = np.array(self.docs, np.int64).reshape(-1, 3)
        chunks = np.array(self.chunks, np.int64).reshape(-1, 2 + PLANES)
        body = struct.pack("<QQ", len(docs), len(chunks)) + docs.astype("<i8").tobytes() + chunks.astype("<i8").tobytes()
        footer, place = self.zip.compress(body), self.place
        self._write(footer + struct.pack("<QQ", place, len(footer)) + MAGIC)
        return int(docs[:, 2].sum())


class PlaneReader:
    """Random access to the documents of a file through its chunk index."""

    def __init__(self, file):
        self.file = file
        self.unzip = zstandard.ZstdDecompressor()
        end = file.size()
        tail = self._at(end - 20, 20)
        head = self._at(0, 12)
        if tail[16:] != MAGIC or head[:4] != MAGIC or struct.unpack("<I", head[4:8])[0] != VERSION:
            raise ValueError("not a bit-plane token file")
        place, size = struct.unpack("<QQ", tail[:16])
        body = self.unzip.decompress(self._at(place, size))
        n_docs, n_chunks = struct.unpack("<QQ", body[:16])
        docs = np.frombuffer(body, "<i8", n_docs * 3, 16).reshape(-1, 3)
        self.doc_ids = [None if null else int(d) for d, null in docs[:, :2].tolist()]
        self.ends = np.cumsum(docs[:, 2])
        self.starts = self.ends - docs[:, 2]
        self.chunks = np.frombuffer(body, "<i8", n_chunks * (2 + PLANES), 16 + n_docs * 24).reshape(-1, 2 + PLANES)
        self.chunk_ends = np.cumsum(self.chunks[:, 1])
        self._last = (-1, np.zeros(0, np.uint32))

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def chunk(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            place, n, *sizes = self.chunks[k].tolist()
            data, at, planes = self._at(place, sum(sizes)), 0, []
            for size in sizes:
                planes.append(self.unzip.decompress(data[at:at + size]) if size else b"")
                at += size
            self._last = (k, join_planes(planes, n))
        return self._last[1]

    def ids(self, doc: int) -> np.ndarray:
        """Ids of the doc-th document."""
        lo, hi = int(self.starts[doc]), int(self.ends[doc])
        out, k = [], int(np.searchsorted(self.chunk_ends, lo, "right"))
        while lo < hi:
            begin = int(self.chunk_ends[k] - self.chunks[k, 1])
            got = self.chunk(k)[lo - begin:hi - begin]
            out.append(got)
            lo += len(got)
            k += 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


# ------------------------------------------------------------ many files

def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2,
                 block: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Tokenize ``docs`` and write them in ascending doc_id order to ``folder`` (by default a
    new one under spark.checkpoint.dir); one file per partition.  Returns the manifest:
    path, documents and ids of each file, in order, with the ids before it.

    NULL doc_ids come first; equal doc_ids are ordered by a hash of the text, so equal rows
    stand together.  NULL text counts as empty.  A task writes under a name of its own
    attempt and moves the finished file into place, so a re-run leaves one whole file.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = read_tokenizer(tokenizer_path)
    base = (folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():06d}.lbpf"
        system, root = _open(base)
        system.create_dir(root, recursive=True)
        own = f"{root}/.{name}.{ctx.taskAttemptId()}"
        enc, n_docs = encoder(spec), 0
        with system.open_output_stream(own) as stream:
            writer = PlaneWriter(stream, block)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    flat, counts = enc.encode(part.column(1).to_pylist())
                    ends = np.cumsum(counts)
                    for k, key in enumerate(part.column(0).to_pylist()):
                        writer.add(key, np.append(flat[ends[k] - counts[k]:ends[k]], np.uint32(end_id)))
                        n_docs += 1
            n_ids = writer.close()
        system.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([ctx.partitionId()], pa.int64()), "path": [f"{base}/{name}"],
            "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    ordered = (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    # one row per file, as many as partitions
    files = ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long").collect()
    before, out = 0, []
    for f in sorted(files, key=lambda r: r["part"]):
        if f["n_docs"]:
            out.append({"path": f["path"], "n_docs": f["n_docs"], "n_ids": f["n_ids"], "before": before})
            before += f["n_ids"]
    return out


def read_tokens(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Read files back: doc_id, ``start`` (ids of all documents before it), n_tokens and the
    ids (little-endian unsigned 32-bit), one row per document."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as file:
                    reader = PlaneReader(file)
                    for lo in range(0, len(reader.doc_ids), 256):
                        rows = range(lo, min(lo + 256, len(reader.doc_ids)))
                        ids = [reader.ids(k) for k in rows]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([reader.doc_ids[k] for k in rows], pa.int64()),
                            "start": pa.array([before + int(reader.starts[k]) for k in rows], pa.int64()),
                            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                            "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())})

    files = spark.createDataFrame([(m["path"], m["before"]) for m in manifest], "path string, before long")
    return files.repartitionByRange(len(manifest), "before").mapInArrow(run, schema)
