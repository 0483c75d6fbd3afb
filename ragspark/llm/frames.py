"""Token-ID files: independent zstandard frames, a document index and a trailing seek table.

A file is a row of zstandard frames, each a run of whole documents' ids as
little-endian integers of the narrowest width. Then follow two skippable frames:
the index (document id, tokens, per document) and the seek table (compressed
size, decompressed size and checksum per frame, the layout of the public seekable
format). Every tool that reads zstandard can decompress the file; a reader that
wants some documents reads the tail and only those documents' frames.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragspark.llm import tokens

#: Fixed values of the public formats: skippable frames, seek table and its footer.
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER, FOOTER_SIZE = "<IBI", 9
ENTRY, ENTRY_SIZE = "<III", 12


def store(folder: str):
    """File system and path of a folder by its URI, local paths included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


#: Wanted ids that a task looks up in a file at once.
SLICE = 10_000


class FrameWriter:
    """Writes documents to one open file."""

    def __init__(self, out, width: int, frame_bytes: int = 1 << 20, level: int = 3):
        self._out, self._width, self._most = out, width, frame_bytes
        self._packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._open: list[bytes] = []
        self._size = 0
        self._entries: list[tuple[int, int, int]] = []
        self._docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self._width):
            raise ValueError(f"id {int(ids.max())} does not fit {self._width} bytes")
        raw = ids.astype(f"<u{self._width}").tobytes()
        if self._size and self._size + len(raw) > self._most:
            self._flush()
        self._docs.append((doc_id, len(ids), len(self._entries)))
        self._open.append(raw)
        self._size += len(raw)

    def _flush(self) -> None:
        raw = b"".join(self._open)
        packed = self._packer.compress(raw)
        self._out.write(packed)
        self._entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._open, self._size = [], 0

    def close(self) -> None:
        if self._open:
            self._flush()
        names = np.array([-(2**63) if d is None else d for d, _, _ in self._docs], "<i8").tobytes()
        sizes = np.array([[n, f] for _, n, f in self._docs], "<u4").tobytes()
        body = zstandard.ZstdCompressor().compress(struct.pack("<BI", self._width, len(self._docs)) + names + sizes)
        self._out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        table = b"".join(struct.pack(ENTRY, *e) for e in self._entries) + struct.pack(FOOTER, len(self._entries), CHECKSUMS, FOOTER_MAGIC)
        # The index is found from the end: its frame lies just before the seek table.
        self._out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Reads documents of a file that supports seeking."""

    def __init__(self, file, size: int):
        self._file = file
        file.seek(size - FOOTER_SIZE)
        count, flags, magic = struct.unpack(FOOTER, file.read(FOOTER_SIZE))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        length = count * ENTRY_SIZE + FOOTER_SIZE
        file.seek(size - length)
        self._entries = list(struct.iter_unpack(ENTRY, file.read(count * ENTRY_SIZE)))
        self._at = np.concatenate(([0], np.cumsum([e[0] for e in self._entries], dtype=np.int64)))
        file.seek(int(self._at[-1]))
        magic, packed = struct.unpack("<II", file.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index before the seek table")
        index = zstandard.ZstdDecompressor().decompress(file.read(packed))
        self.width, n = struct.unpack_from("<BI", index)
        names = np.frombuffer(index, "<i8", n, 5)
        self.doc_ids = [None if d == -(2**63) else int(d) for d in names]
        sizes = np.frombuffer(index, "<u4", 2 * n, 5 + 8 * n).reshape(n, 2).astype(np.int64)
        self.tokens, self._frame = sizes[:, 0], sizes[:, 1]
        self._cached: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._cached[0] != k:
            self._file.seek(int(self._at[k]))
            packed, size, check = self._entries[k]
            raw = zstandard.ZstdDecompressor().decompress(self._file.read(packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self._cached = (k, raw)
        return self._cached[1]

    def ids(self, places: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, ids) of the documents at the given places; other frames are not touched."""
        total = np.concatenate(([0], np.cumsum(self.tokens)))
        for i in places:
            k = int(self._frame[i])
            first = int(np.searchsorted(self._frame, k))
            begin = int(total[i] - total[first])
            yield self.doc_ids[i], np.frombuffer(self.frame(k), f"<u{self.width}", int(self.tokens[i]), begin * self.width)


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, width: int | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode every whole text and write files in ascending doc_id order; one row per file.

    Result (already computed, small): part, file, n_docs, n_tokens, first_id, last_id. Documents are dealt
    into ranges of doc_id, each range one sorted file; rows of equal id follow by text; a null
    id comes first. A task writes under a name of its own attempt, and the manifest names the
    attempt that Spark accepted, so lost executors leave at most an orphan file. Null text is
    the end id alone. ``width`` is the bytes of an id, by default 2 or 4 as the vocabulary needs; an id that does not
    fit ends the job with an error. Extra columns are ignored. An empty table writes no file.
    """
    spark = docs.sparkSession
    width = width or (2 if max(tokens.vocabulary(path), end_id + 1) <= 1 << 16 else 4)
    end = np.asarray([end_id], "<u4").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-int(size) // file_bytes))
    ranged = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = tokens.encoder(path)
        files, base = store(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zst"
        writer, n_docs, n_tokens, known = None, 0, 0, []
        with files.open_output_stream(f"{base}/{name}", compression=None) as out:
            writer = FrameWriter(out, width)
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    ids = np.frombuffer(encode(text) + end, "<u4")
                    writer.add(None if pd.isna(doc_id) else int(doc_id), ids)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
                    if not pd.isna(doc_id):
                        # Rows come in order: the first id and the latest one.
                        known = [*known[:1], int(doc_id)]
            writer.close()
        if not n_docs:
            files.delete_file(f"{base}/{name}")
        else:
            yield pd.DataFrame({"part": [task.partitionId()], "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens],
                                "first_id": pd.array(known[:1] or [None], "Int64"), "last_id": pd.array(known[-1:] or [None], "Int64")})

    manifest = ranged.mapInPandas(write, "part int, file string, n_docs long, n_tokens long, first_id long, last_id long")
    target = f"{folder.rstrip('/')}/manifest-{uuid.uuid4().hex}"
    manifest.write.parquet(target)
    return spark.read.parquet(target)


def read_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    ``start`` counts the ids of all documents before it in the order of the files.
    """
    import zlib

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: the running sum over the manifest is small however large the files are.
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files_n = max(1, manifest.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = store(folder)
        for batch in batches:
            for name, start in zip(batch["file"], batch["start"]):
                where = f"{base}/{name}"
                with files.open_input_file(where) as file:
                    reader = FrameReader(file, file.size())
                    rows = [(d, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, x in reader.ids(range(len(reader.tokens)))]
                out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["start"] = int(start) + out["n_tokens"].cumsum() - out["n_tokens"]
                yield out[["doc_id", "start", "n_tokens", "ids_crc32"]]

    return placed.select("file", "start").repartition(files_n, "file").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_documents(spark: SparkSession, manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (array) of the documents named in ``wanted``; only their frames are decompressed.

    Ids that no file holds give no row; repeated rows of a document are all returned, a null id none. Wanted ids meet
    the manifest, one row a file, by their range, and each task gets those of its files in slices of ``SLICE``
    or so; nothing of them passes the driver.
    """
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    held = manifest.select("file", "first_id", "last_id")
    aimed = ids.join(held, (F.col("doc_id") >= F.col("first_id")) & (F.col("doc_id") <= F.col("last_id"))).select("file", "doc_id")
    slices = aimed.groupBy("file").agg(F.ceil(F.count("*") / SLICE).alias("n"))
    dealt = aimed.join(slices, "file").groupBy("file", F.pmod(F.xxhash64("doc_id"), F.col("n")).alias("slice")).agg(
        F.collect_list("doc_id").alias("ids")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = store(folder)
        for batch in batches:
            for name, some in zip(batch["file"], batch["ids"]):
                asked = set(some)
                with files.open_input_file(f"{base}/{name}") as file:
                    reader = FrameReader(file, file.size())
                    places = [i for i, d in enumerate(reader.doc_ids) if d in asked]
                    for d, x in reader.ids(places):
                        yield pd.DataFrame({"doc_id": [d], "ids": [x.astype(np.int64)]})

    return dealt.select("file", "ids").mapInPandas(read, "doc_id long, ids array<long>")
