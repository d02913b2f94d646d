"""Token ids in binary files: one zstandard frame for each document, with a dictionary shared by all.

A folder holds the dictionary, in a file named by its SHA-256, and token files. A token file holds, in
ascending doc_id order: the magic, the bytes of an id (2, or 4 for vocabularies of over 65536 entries), the SHA-256 of the dictionary, one frame for
each document, the index (doc_id, offset, frame bytes, ids; 24 bytes a document), the
index's offset, the number of documents and the magic again. A reader needs the folder only: it gets at one short document
by the footer, a search of the index and one frame. Ids are serialized as little-endian
integers. The dictionary serves short documents, so it is trained on the serialized ids of at
about SAMPLE whole documents of up to SAMPLE_CHARS characters, those with hashes below a threshold from their number; it
affects the size of the files only.

A file has about FILE_BYTES of text, whatever the table's size. A task writes under a name of its own and reports the file in its output; a task that is run
again writes another file, and only files that were reported are read.

Defined cases: a null or empty text has the end id alone; a null doc_id is held as the least long
and comes first; rows with one doc_id are ordered by a hash of the text, and a search finds the first of them; a text of any length is one frame (its ids are held in memory
once); an empty table has no files; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import Block, blocks
from .chunks import ChunkCode, cut_spans
from .store import new_path

MAGIC, LEVEL, DICTIONARY_BYTES, SAMPLE, SAMPLE_CHARS, END = b"CPTOKID2", 3, 64 << 10, 1000, 8000, 1
FILE_BYTES = 256 << 20
NULL_ID = -(2**63)
_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("n_tokens", "<u4")])
_HEADER, _FOOTER = "<8sB32s", "<QQ8s"
_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [9, 10, 13, 32])
_ASCII_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
#: First bytes of U+00C0 to U+027F and of U+0400 to U+047F: letters but for the two signs below; U+0130 becomes a letter and a mark.
_TWO_BYTES = ((_BYTE >= 0xC3) & (_BYTE <= 0xC9)) | (_BYTE == 0xD0) | (_BYTE == 0xD1)
_NOT_LETTERS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which is given each distinct chunk once.

    A text is cut at ASCII white space, which the tokenizer drops, and between a letter (of ASCII or of
    a few blocks of letters; marks, digits and signs outside ASCII aren't told from letters by a byte, so there is no cut behind them) and a
    following ASCII character that is neither letter nor white space: no token, normalization or contraction reaches
    over these. Texts with the start of a special token are given to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.code = ChunkCode(self._encode_chunks)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for at in range(0, len(chunks), 20_000):
            part = [c.decode("utf-8", "replace") for c in chunks[at : at + 20_000]]
            starts = np.cumsum([0] + [len(c) + 1 for c in part])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begin = np.array([a for a, _ in found.offsets], np.int64)
            ids.append(np.array(found.ids, np.int32))
            counts.append(np.bincount(np.searchsorted(starts, begin, "right") - 1, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64)

    def __call__(self, block: Block) -> list[np.ndarray]:
        data = block.data
        cut = _SPACE[data]
        letter = _ASCII_LETTER[data]
        if len(data) > 1:
            two = _TWO_BYTES[data[:-1]]
            for sign in _NOT_LETTERS:
                two &= (data[:-1] != sign[0]) | (data[1:] != sign[1])
            letter[1:] |= two
        cut[1:] |= (letter[:-1] & (data[1:] < 0x80) & ~_ASCII_LETTER[data[1:]]) | _SPACE[data[:-1]]
        doc, starts, ends, hashes = cut_spans(block, cut, ~_SPACE[data])
        ids, times = self.code(data, starts, ends, hashes)
        end = np.cumsum(np.bincount(doc, times, minlength=block.rows)).astype(np.int64)
        out = np.split(ids, end[:-1]) if block.rows else []
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else []
        for i in np.unique(np.searchsorted(block.offsets, special, "right") - 1):
            out[i] = self.whole(block.text(i).decode("utf-8", "replace"))
        return out


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that its (bounded) table of chunks serves many tasks."""
    return WordEncoder(path)


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _dtype(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _short() -> Column:
    return F.length("text").between(1, SAMPLE_CHARS)


def train_dictionary(docs: DataFrame, tokenizer_path: str, n_short: int, sample: int = SAMPLE) -> bytes:
    """A dictionary from the serialized ids of a bounded sample of n_short short documents; b"" where there is too little to learn from.

    A document is in the sample if its hash is below the share that the sample has of all, so no task sorts or gathers hashes.
    """
    import zstandard

    if not n_short:
        return b""
    most = min(2**63 - 1, -(2**63) + 2**64 * sample // n_short)
    rows = docs.where(_short() & (F.xxhash64("doc_id", "text") <= most)).select("text").limit(2 * sample).collect()
    encoder = WordEncoder(tokenizer_path)
    samples = [ids.astype(_dtype(encoder.size)).tobytes() for block in blocks(pa.array([r["text"] for r in rows], pa.string())) for ids in encoder(block)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # a handful of short texts
        return b""


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def _store_dictionary(folder: str, raw: bytes) -> bytes:
    """Write the dictionary beside the files; returns its SHA-256."""
    digest = hashlib.sha256(raw).digest()
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{digest.hex()}.dictionary") as out:
        out.write(raw)
    return digest


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs(doc_id, text) in ascending doc_id order; one row for each file (path, first, n_docs, n_tokens, part)."""
    spark = docs.sparkSession
    total, n_short = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(_short())).first()
    raw = train_dictionary(docs, tokenizer_path, n_short)
    digest = _store_dictionary(folder, raw)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = slim.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw))
        encoder, stream, index, at = worker_encoder(tokenizer_path), None, [], struct.calcsize(_HEADER)
        kind = _dtype(encoder.size)
        for batch in batches:
            ids_of = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                if stream is None:
                    system, path = _filesystem(folder)
                    name = f"{uuid.uuid4().hex}.ids"
                    stream = system.open_output_stream(f"{path}/{name}")
                    stream.write(struct.pack(_HEADER, MAGIC, np.dtype(kind).itemsize, digest))
                entries = np.zeros(block.rows, _INDEX)
                entries["doc_id"] = ids_of[block.first : block.first + block.rows]
                for i, ids in enumerate(encoder(block)):
                    frame = press.compress(np.append(ids, end_id).astype(kind).tobytes())
                    stream.write(frame)
                    entries["bytes"][i], entries["n_tokens"][i] = len(frame), len(ids) + 1
                entries["offset"] = at + np.cumsum(entries["bytes"], dtype=np.uint64) - entries["bytes"]
                at += int(entries["bytes"].sum(dtype=np.int64))
                index.append(entries)
        if stream is not None:
            n_docs, n_tokens = sum(map(len, index)), sum(int(e["n_tokens"].sum(dtype=np.int64)) for e in index)
            for entries in index:
                stream.write(entries.tobytes())
            stream.write(struct.pack(_FOOTER, at, n_docs, MAGIC))
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([index[0]["doc_id"][0]], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["path", "first", "n_docs", "n_tokens"])

    files = ordered.mapInArrow(write, "path string, first long, n_docs long, n_tokens long").withColumn("part", F.spark_partition_id())
    rows = sorted(files.collect(), key=lambda r: r["part"])  # one for each file
    return spark.createDataFrame([tuple(r) for r in rows], "path string, first long, n_docs long, n_tokens long, part int")


class TokenFile:
    """Random access to the documents of one file; the dictionary lies in its folder."""

    def __init__(self, uri: str):
        import zstandard

        system, path = _filesystem(uri)
        self.file = system.open_input_file(path)
        self.file.seek(self.file.size() - struct.calcsize(_FOOTER))
        at, n, end = struct.unpack(_FOOTER, self.file.read(struct.calcsize(_FOOTER)))
        self.file.seek(0)
        magic, width, digest = struct.unpack(_HEADER, self.file.read(struct.calcsize(_HEADER)))
        if not magic == end == MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.kind = f"<u{width}"
        with system.open_input_file(f"{path.rsplit('/', 1)[0]}/{digest.hex()}.dictionary") as stored:
            raw = stored.read()
        if hashlib.sha256(raw).digest() != digest:
            raise ValueError(f"{uri}: the dictionary in its folder is another one")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(n * _INDEX.itemsize), _INDEX)
        self.press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def ids(self, row: int) -> np.ndarray:
        entry = self.index[row]
        self.file.seek(int(entry["offset"]))
        return np.frombuffer(self.press.decompress(self.file.read(int(entry["bytes"]))), self.kind)

    def document(self, doc_id: int) -> np.ndarray:
        row = int(np.searchsorted(self.index["doc_id"], doc_id))
        if row == len(self.index) or self.index["doc_id"][row] != doc_id:
            raise KeyError(doc_id)
        return self.ids(row)


def read_token_files(spark: SparkSession, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless only these are wanted, ids of all documents, a task for each file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = sorted(files.collect(), key=lambda r: r["part"])
    starts = np.cumsum([0] + [r["n_tokens"] for r in rows]).tolist()
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(r["path"], s) for r, s in zip(rows, starts, strict=False)], "path string, start long").repartition(len(rows), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                begin = start + np.cumsum(file.index["n_tokens"].astype(np.int64)) - file.index["n_tokens"]
                for at in range(0, len(file.index), 500):
                    part = [file.ids(i).astype("<u4") for i in range(at, min(at + 500, len(file.index)))]
                    ids = [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in part]), pa.int32()), pa.array(np.concatenate(part).view(np.int32)))] if with_ids else []
                    doc_ids = file.index["doc_id"][at : at + 500].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(begin[at : at + 500]), pa.array([len(p) for p in part], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in part], pa.int64()), *ids],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids],
                    )

    return listed.mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Write the files (in the shared folder unless another is named) and read them back."""
    spark = docs.sparkSession
    files = write_token_files(docs, tokenizer_path, folder or new_path(spark, "token_files"))
    return read_token_files(spark, files, with_ids=with_ids)
