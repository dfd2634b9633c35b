"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, in the public seekable layout: data frames that hold the ids of
consecutive documents as little-endian integers, one index frame (an Arrow table of document ids and
lengths), and a skippable frame with the seek table: compressed size, plain size and checksum of each
frame (the low 32 bits of XXH64 of the plain bytes). A reader takes the table from the file's end,
finds a document's frames in it, and decompresses those alone.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the seekable layout.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")

MANIFEST = "part long, file string, documents long, n_ids long, width int, id_type string"


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class FrameWriter:
    """Appends frames to a stream and keeps their seek table."""

    def __init__(self, out, level: int = 3) -> None:
        import zstandard

        self.out, self.entries = out, []
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def frame(self, data: bytes) -> None:
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), _checksum(data)))

    def close(self) -> None:
        table = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class TokenFile:
    """Reads documents of one file; ``frames_read`` counts the frames that were decompressed."""

    def __init__(self, path: str, width: int = 4) -> None:
        import zstandard

        fs, at = _filesystem(path)
        self.file, self.dtype, self.frames_read = fs.open_input_file(at), f"<u{width}", 0
        self.unzip = zstandard.ZstdDecompressor()
        end = self.file.size()
        count, flag, magic = FOOTER.unpack(self._bytes(end - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table with checksums")
        table = self._bytes(end - FOOTER.size - count * ENTRY.size, count * ENTRY.size)
        self.entries = np.frombuffer(table, "<u4").reshape(count, 3).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.entries[:, 0]))
        self.plain = np.append(0, np.cumsum(self.entries[:-1, 1]))  # of the data frames
        self.index = pa.ipc.open_stream(self._frame(count - 1)).read_all()
        self.ends = np.cumsum(self.index.column("count").to_numpy())

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _frame(self, k: int) -> bytes:
        packed, size, check = (int(x) for x in self.entries[k])
        data = self.unzip.decompress(self._bytes(int(self.at[k]), packed), max_output_size=size)
        if _checksum(data) != check:
            raise ValueError(f"frame {k}: checksum does not match")
        self.frames_read += 1
        return data

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the given rows, in rising order, or of all; holds the frames of one document."""
        width, held = np.dtype(self.dtype).itemsize, {}
        for row in range(len(self.ends)) if rows is None else rows:
            high = int(self.ends[row]) * width
            low = (int(self.ends[row - 1]) if row else 0) * width
            first = max(int(np.searchsorted(self.plain, low, "right")) - 1, 0)
            last = max(int(np.searchsorted(self.plain, high, "left")) - 1, first)
            held = {k: held.get(k) or self._frame(k) for k in range(first, min(last, len(self.plain) - 2) + 1)}
            data = b"".join(held.values())
            yield row, np.frombuffer(data[low - int(self.plain[first]):high - int(self.plain[first])], self.dtype)

    def close(self) -> None:
        self.file.close()


def write_store(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    kind: str = "byte",
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    width: int = 4,
    frame_ids: int = 1 << 16,
) -> DataFrame:
    """Encode every text whole, append ``end_id``, write one file per partition; returns the manifest.

    Documents are range-partitioned by (id, text), so file after file holds them in ascending id
    order, null ids first; rows with one id follow each other by text. A null text is empty: the end
    id alone. Other columns are left out, so their names cannot clash; an empty table gives an empty
    manifest and no file. Frames hold at most ``frame_ids`` ids; a longer document spans several.

    ``folder`` must be a place that all executors see. A task writes under a name of its own and
    renames the whole file at its end, so a repeated or a second attempt leaves one whole file. The
    manifest, written last, lists the files that count.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = rows.select("id", "text", F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from intelweave.llm.tokens import encoder

        fs, at = _filesystem(folder)
        enc, out, names, counts, rest, total = encoder(tokenizer, kind), None, [], [], np.empty(0, np.uint32), 0
        for batch in batches:
            if batch.num_rows and out is None:
                part = batch.column(2)[0].as_py()
                fs.create_dir(at, recursive=True)
                own = f"{at}/.{part:08d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(own, compression=None)
                writer = FrameWriter(out)
            for a in range(0, batch.num_rows, 500):
                ids, n, _ = enc.encode(batch.column(1).slice(a, 500).to_pylist(), end_id)
                names.append(batch.column(0).slice(a, 500))
                counts.append(n)
                total += len(ids)
                rest = np.concatenate([rest, ids])
                whole = len(rest) - len(rest) % frame_ids
                for b in range(0, whole, frame_ids):
                    writer.frame(rest[b:b + frame_ids].astype(f"<u{width}").tobytes())
                rest = rest[whole:]
        if out is None:
            return
        if len(rest):
            writer.frame(rest.astype(f"<u{width}").tobytes())
        index = pa.table({"id": pa.chunked_array(names), "count": np.concatenate(counts)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        writer.frame(sink.getvalue().to_pybytes())
        writer.close()
        out.close()
        name = f"part-{part:08d}.zst"
        fs.move(own, f"{at}/{name}")
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "documents": len(index), "n_ids": total, "width": width, "id_type": id_type}],
                                         pa.schema([("part", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("id_type", pa.string())]))

    rows.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_store(spark: SparkSession, folder: str, only: list | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents of a store: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` as 32-bit little-endian.

    ``only`` names a few ids: then no other documents' frames are decompressed. The running sum over
    the manifest has one row per file, not per document. Each file is a task of its own: the number of
    partitions is given, so adaptive execution leaves them apart, and ranges of ``part`` hold a file each.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = files.agg(F.count("*").alias("n"), F.min("id_type").alias("id_type")).first()
    id_type = held["id_type"] or "bigint"
    files = files.select("part", "file", "width", before.cast("long").alias("before")).repartitionByRange(max(held["n"], 1), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                file = TokenFile(f"{folder}/{f['file']}", f["width"])
                names = file.index.column("id").combine_chunks()
                if isinstance(names, pa.ChunkedArray):
                    names = pa.concat_arrays(names.chunks)
                rows = None
                if only is not None:
                    rows = np.flatnonzero(np.isin(np.array(names.to_pylist(), object), np.array(only, object))).tolist()
                some, size = [], 0
                for row, ids in file.documents(rows):
                    some.append((row, ids))
                    size += len(ids)
                    if size > 1 << 21:
                        yield _batch(file, names, some, f["before"])
                        some, size = [], 0
                if some:
                    yield _batch(file, names, some, f["before"])
                file.close()

    return files.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def _batch(file: TokenFile, names: pa.Array, some: list[tuple[int, np.ndarray]], before: int) -> pa.RecordBatch:
    rows = np.array([r for r, _ in some])
    n = np.array([len(x) for _, x in some])
    raw = pa.array([x.astype("<u4").tobytes() for _, x in some], pa.binary())
    return pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.array(before + file.ends[rows] - n), pa.array(n), raw], names=["id", "start", "n_tokens", "ids"])
