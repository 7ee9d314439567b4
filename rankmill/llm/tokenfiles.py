"""Token ids in binary files from which single documents can be read.

A part of the documents, in order of their ids, is two files of independent zstandard frames: one with all token ids
as little-endian 32-bit numbers, one with a fixed record per document (its id and place). Each file ends with a seek
table in a skippable frame, as the public seekable format of zstandard lays it out: compressed size, size and checksum
(low half of XXH64) of every frame, the number of frames, a descriptor and a magic number. Any zstandard reader can
decompress the files whole; a reader of single documents takes the frames it needs and checks each.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.sources.scratch import keep

# Token ids, and document records, in one frame.
FRAME_IDS = 1 << 16
FRAME_DOCS = 1 << 10
END = 2

# Fixed values of the seekable format: the skippable frame's magic number, the table's own, and the bit that says
# that entries have checksums.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")
_HEAD = struct.Struct("<II")
# A document: whether its id is null, the id, where its token ids begin in the part, how many they are.
_RECORD = np.dtype([("null", "<i8"), ("id", "<i8"), ("at", "<i8"), ("n", "<i8")])
# Bytes of token ids in one batch of results; a longer document makes one of its own.
_BATCH_BYTES = 4 << 20


# --- tokenizer ---------------------------------------------------------------------------------------

# Distinct pieces of text whose ids a worker remembers.
_REMEMBERED = 400_000
# A line in which words and signs can be told apart without tables: blanks, visible ASCII but the apostrophe, and the
# letters of Latin-1. No character of it takes part in composition.
_SIMPLE = re.compile("[ \t\x0b\x0c\r!-&(-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \t\x0b\x0c\r]+")
_ASCII_BLANKS = re.compile("[ \t\n\x0b\x0c\r]+")


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte: itself if it is visible, else one from U+0100 on in turn."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {**{b: chr(b) for b in visible}, **{b: chr(0x100 + i) for i, b in enumerate(others)}}


class _Remembered(dict):
    """Computes a missing value; forgets all at a fixed size."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        value = self._make(key)
        if len(key) <= 64:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[key] = value
        return value


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """BPE over words that white space always separates, read from the JSON file of the tokenizers library.

    The ids of a text are those of its stretches without white space, one after the other. The stretches of a
    simple line are cut to words, digits and signs here, and each distinct one goes to the library's model once; any
    other distinct stretch goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._letters = _byte_letters()
        self._pieces = _Remembered(self._piece)
        self._stretches = _Remembered(self._stretch)

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(self._letters.__getitem__, piece.encode()))
        return _packed([t.id for t in self._model.tokenize(letters)])

    def _stretch(self, text: str) -> bytes:
        return _packed(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        out: list[bytes] = []
        for line in text.split("\n"):
            if _SIMPLE.fullmatch(line) and not any(s in line for s in self._special):
                out.extend(map(self._pieces.__getitem__, _PIECES.findall(line.lower())))
            else:
                out.extend(map(self._stretches.__getitem__, filter(None, _ASCII_BLANKS.split(line))))
        return b"".join(out)


def public_tokenizer() -> WordTokenizer:
    """The vocabulary of 49,408 ids with word ends from the folder of public tokenizers."""
    import public_tokenizers

    return WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))


# The tokenizer of this Python worker, by the function that makes it.
_MADE: dict = {}


def _tokenizer(make):
    if make not in _MADE:
        _MADE[make] = make()
    return _MADE[make]


# --- files -------------------------------------------------------------------------------------------


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    # Spark also writes local paths with one slash after the scheme.
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


class FrameWriter:
    """Writes bytes as independent frames of ``frame_bytes`` and, at the end, the seek table."""

    def __init__(self, stream, frame_bytes: int):
        self._stream = stream
        self._frame_bytes = frame_bytes
        self._compressor = zstandard.ZstdCompressor(level=3)
        self._held = bytearray()
        self._entries: list[bytes] = []

    def _flush(self, data: bytes) -> None:
        frame = self._compressor.compress(data)
        self._stream.write(frame)
        self._entries.append(_ENTRY.pack(len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def write(self, data: bytes) -> None:
        self._held += data
        first = 0
        while len(self._held) - first >= self._frame_bytes:
            self._flush(bytes(self._held[first : first + self._frame_bytes]))
            first += self._frame_bytes
        del self._held[:first]

    def close(self) -> None:
        if self._held:
            self._flush(bytes(self._held))
        table = b"".join(self._entries)
        self._stream.write(_HEAD.pack(SKIPPABLE_MAGIC, len(table) + _FOOTER.size))
        self._stream.write(table)
        self._stream.write(_FOOTER.pack(len(self._entries), HAS_CHECKSUMS, SEEKABLE_MAGIC))
        self._stream.close()


class FrameReader:
    """Reads ranges of a file's content; only the frames that hold them are read, checked and decompressed."""

    def __init__(self, path: str):
        fs, name = _open(path)
        self.path = path
        self.decompressed = 0
        self._file = fs.open_input_file(name)
        size = self._file.size()
        n, descriptor, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE_MAGIC or descriptor != HAS_CHECKSUMS:
            raise ValueError(f"no seek table with checksums at the end of {path}")
        table = self._at(size - _FOOTER.size - n * _ENTRY.size, n * _ENTRY.size)
        entries = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self._offsets = np.concatenate(([0], np.cumsum(entries[:, 0])))
        self._edges = np.concatenate(([0], np.cumsum(entries[:, 1])))
        self._checksums = entries[:, 2]
        self._decompressor = zstandard.ZstdDecompressor()
        self._last = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self._file.seek(int(offset))
        return self._file.read(int(size))

    def frame(self, number: int) -> bytes:
        if self._last[0] != number:
            packed = self._at(self._offsets[number], self._offsets[number + 1] - self._offsets[number])
            size = int(self._edges[number + 1] - self._edges[number])
            data = self._decompressor.decompress(packed, max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self._checksums[number]:
                raise ValueError(f"frame {number} of {self.path} does not match its checksum")
            self.decompressed += 1
            self._last = (number, data)
        return self._last[1]

    def read(self, start: int, size: int) -> bytes:
        out, number = [], int(np.searchsorted(self._edges, start, "right")) - 1
        while size > 0:
            begin = start - int(self._edges[number])
            part = self.frame(number)[begin : begin + size]
            out.append(part)
            start, size, number = start + len(part), size - len(part), number + 1
        return b"".join(out)

    def close(self) -> None:
        self._file.close()


# --- writing -----------------------------------------------------------------------------------------


class _Part:
    """The two files of one task's documents, under names that no other attempt uses."""

    def __init__(self, path: str, frame_ids: int, frame_docs: int):
        self.number = TaskContext.get().partitionId()
        stem = f"part-{self.number:06d}-{uuid.uuid4().hex}"
        self.names = [f"{stem}.ids.zst", f"{stem}.docs.zst"]
        streams = []
        for name in self.names:
            fs, where = _open(f"{path}/{name}")
            streams.append(fs.open_output_stream(where, compression=None))
        self.ids = FrameWriter(streams[0], frame_ids * 4)
        self.docs = FrameWriter(streams[1], frame_docs * _RECORD.itemsize)
        self.n_docs = self.n_ids = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.write(np.array((doc is None, doc or 0, self.n_ids, n), _RECORD).tobytes())
        self.ids.write(ids)
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + n


def write_tokens(
    documents: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer=public_tokenizer,
    end: int = END,
    frame_ids: int = FRAME_IDS,
    frame_docs: int = FRAME_DOCS,
    num_partitions: int | None = None,
) -> DataFrame:
    """Write all documents to ``path`` in ascending order of their integer ids; returns the manifest, a row a part.

    A document is the ids of its whole text and ``end``; a null or empty text is ``end`` alone. Null ids come first;
    rows of one id follow a digest of their texts, equal rows come in any order. A very long text is encoded whole and
    spans frames; an empty table gives a manifest without rows. Other columns are not read, whatever their names.

    Each task sorts a range of ids and streams it to files of its own; rows that share an id are split between tasks
    too. The manifest names the files of the attempts that succeeded, so files that a lost one left behind are never
    read. ``path`` must be on storage that all executors share and that Arrow's file systems open.
    """
    spark = documents.sparkSession
    partitions = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, folder = _open(path)
    fs.create_dir(folder)
    frame_settings = (frame_ids, frame_docs)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, part = _tokenizer(tokenizer).ids, np.array([end], "<u4").tobytes(), None
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                part = part or _Part(path, *frame_settings)
                part.add(doc.as_py(), encode(text.as_py() or "") + last)
        if part is None:
            return
        part.ids.close()
        part.docs.close()
        row = [part.number, *part.names, part.n_docs, part.n_ids]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)],
            names=["part", "ids_file", "docs_file", "n_docs", "n_ids"],
        )

    order = ["_id", "_digest", "_row"]
    ranged = (
        documents.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
        .withColumns({"_digest": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
        .repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
    )
    schema = "part int, ids_file string, docs_file string, n_docs bigint, n_ids bigint"
    parts = keep(ranged.select("_id", "_text").mapInArrow(write, schema), "parts")
    # One row a part.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))
    parts.withColumns({"start": start, "frame_docs": F.lit(frame_docs)}).coalesce(1).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


# --- reading -----------------------------------------------------------------------------------------


def document_index(spark: SparkSession, path: str, num_partitions: int | None = None) -> DataFrame:
    """(doc_id, ids_file, at, start, n_tokens) of every document, from the records alone.

    ``start`` counts the token ids of all documents before, ``at`` those in the same file.
    """
    partitions = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_docs") / F.col("frame_docs")).cast("int") - 1))
    work = read_manifest(spark, path).select("docs_file", "ids_file", "start", frames.alias("frame"))
    names = ["doc_id", "ids_file", "at", "start", "n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = FrameReader(f"{path}/{row['docs_file']}")
                records = np.frombuffer(reader.frame(row["frame"]), _RECORD)
                reader.close()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(records["id"].astype(np.int64), mask=records["null"] != 0),
                        pa.array([row["ids_file"]] * len(records), pa.string()),
                        pa.array(records["at"].astype(np.int64)),
                        pa.array(records["at"] + row["start"], pa.int64()),
                        pa.array(records["n"].astype(np.int64)),
                    ],
                    names=names,
                )

    schema = "doc_id bigint, ids_file string, at bigint, start bigint, n_tokens bigint"
    return work.repartition(partitions, "docs_file", "frame").mapInArrow(read, schema)


def _contents(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Index rows with the bytes of their token ids, some megabytes at a time."""
    readers: dict[str, FrameReader] = {}
    for batch in batches:
        files, at, n = (batch.column(i).to_pylist() for i in (1, 2, 4))
        first, held, size = 0, [], 0
        for i, file in enumerate(files):
            if file not in readers:
                for reader in readers.values():
                    reader.close()
                readers = {file: FrameReader(f"{path}/{file}")}
            held.append(readers[file].read(at[i] * 4, n[i] * 4))
            size += len(held[-1])
            if size >= _BATCH_BYTES or i + 1 == len(files):
                yield batch.slice(first, i + 1 - first), held
                first, held, size = i + 1, [], 0


def with_tokens(index: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` to rows of ``document_index``; only frames that hold one of their documents are decompressed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, contents in _contents(path, batches):
            lists = [np.frombuffer(c, "<u4").astype(np.int32) for c in contents]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([*rows.columns, ids], names=[*rows.schema.names, "ids"])

    rows = index.select("doc_id", "ids_file", "at", "start", "n_tokens")
    schema = "doc_id bigint, ids_file string, at bigint, start bigint, n_tokens bigint, ids array<int>"
    return rows.mapInArrow(read, schema)


def with_checksums(index: DataFrame, path: str) -> DataFrame:
    """Adds ``ids_crc32``, the unsigned CRC-32 of the bytes of a document's token ids as they were read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, contents in _contents(path, batches):
            sums = pa.array([zlib.crc32(c) for c in contents], pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns, sums], names=[*rows.schema.names, "ids_crc32"])

    rows = index.select("doc_id", "ids_file", "at", "start", "n_tokens")
    schema = "doc_id bigint, ids_file string, at bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return rows.mapInArrow(read, schema)


def read_documents(spark: SparkSession, path: str, wanted: Sequence[int] | DataFrame) -> DataFrame:
    """The token ids of the documents with the wanted ids (a list, or a table with a column ``doc_id``).

    The records are read, the frames of other documents are not. An id that is not there gives no row; rows that
    share a wanted id all come.
    """
    if not isinstance(wanted, DataFrame):
        wanted = spark.createDataFrame([(int(i),) for i in wanted], "doc_id bigint")
    found = document_index(spark, path).join(wanted.select("doc_id"), "doc_id", "left_semi")
    return with_tokens(found.repartition("ids_file").sortWithinPartitions("ids_file", "at"), path)
