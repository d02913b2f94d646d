"""Byte-level BPE: ids of whole texts by replaying the merges over distinct words, and texts from ids.

A rank file gives each token's bytes and rank; a rank is also the token's id. A text is cut into words by the
pattern that belongs to the file. A word that is a token itself has that token's id, as in the tiktoken
library. The other words of a task, each distinct one once, are a corpus over which the merges are replayed:
an inverted index tells at which places of which words a pair of neighbouring tokens stands, the ranks come in
ascending order, and a merge looks at the places of its pairs alone, where it links the neighbours
anew and enters their new pairs in the index. Now and then a merge makes a pair whose rank is lower than its own; it is
then that word's next merge, and the word's later places of the rank at hand wait until it is done.

Words come in blocks of texts; what was found for a chunk of text is kept in the Python worker, in a table of
bounded bytes, so a word that was seen before costs a search only. Chunks are cut before a space that begins a word,
where no match of the pattern reaches across (so for PATTERN; another pattern works on whole texts).

Defined cases: null and empty texts have no ids and decode to the empty text; special tokens have no meaning, their
spelling is text; repeated rows each get a row, null ids of documents included; a text of any length is encoded whole (one
of over 2 MB is a block of its own, and a single match of the pattern takes some 200 bytes of memory for each of its bytes);
an empty table gives an empty result; other columns, whatever their names, play no part in encoding and stay in
decoding. Ids that are no token's raise an error when decoded; decoded bytes that aren't UTF-8 become U+FFFD in decoded texts.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .bytewords import Block, blocks
from .chunks import ChunkCode, cut_spans
from .store import fresh

#: Words replayed together have at most about so many bytes.
REPLAY_BYTES = 1 << 20
#: Bytes after a space that surely begin no white space: ASCII, and lead bytes of characters none of which is one.
_BYTE = np.arange(256)
_PLAIN = ((_BYTE < 0x80) & (_BYTE != 0x20) & ~((_BYTE >= 9) & (_BYTE <= 13))) | ((_BYTE >= 0xC3) & ~np.isin(_BYTE, [0xE1, 0xE2, 0xE3]))


class Merges:
    """The tokens of a rank file and the rank of each pair of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: by first token * size + second token
        self.pairs = {ranks[t[:k]] * self.size + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.of_bytes = np.full((256, 256), -1, np.int64)
        for t, r in ranks.items():
            if len(t) == 2:
                self.of_bytes[t[0], t[1]] = r

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (none of them empty) once all merges are done."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        first = np.zeros(len(data), bool)
        first[np.append(0, ends[:-1])] = True
        last = np.append(first[1:], True)
        token = self.of_byte[data].tolist()
        after = np.where(last, -1, np.arange(1, len(data) + 1)).tolist()
        before = np.where(first, -1, np.arange(-1, len(data) - 1)).tolist()
        word_end = np.repeat(ends, np.diff(ends, prepend=0))
        pair = np.append(self.of_bytes[data[:-1], data[1:]], -1)
        pair[last] = -1
        places = np.flatnonzero(pair >= 0)
        places = places[np.argsort(pair[places], kind="stable")]
        found, at = np.unique(pair[places], return_index=True)
        index = dict(zip(found.tolist(), (x.tolist() for x in np.split(places, at[1:])), strict=True)) if len(found) else {}
        pair, alive, size, pairs = pair.tolist(), [True] * len(data), self.size, self.pairs
        ranks = list(index)
        heapify(ranks)

        def enter(place: int, rank: int) -> None:
            pair[place] = rank
            if rank in index:
                index[rank].append(place)
            elif rank >= 0:
                index[rank] = [place]
                heappush(ranks, rank)

        while ranks:
            rank = heappop(ranks)
            wait, later = -1, []
            for i in sorted(index.pop(rank)):
                if pair[i] != rank:
                    continue  # an earlier merge took one of the two
                if i < wait:
                    later.append(i)
                    continue
                j = after[i]
                k = after[i] = after[j]
                token[i], pair[i], pair[j], alive[j] = rank, -1, -1, False
                lower = False
                if k >= 0:
                    before[k] = i
                    new = pairs.get(rank * size + token[k], -1)
                    enter(i, new)
                    lower = 0 <= new < rank
                h = before[i]
                if h >= 0:
                    new = pairs.get(token[h] * size + rank, -1)
                    enter(h, new)
                    lower = lower or 0 <= new < rank
                if lower:
                    wait = int(word_end[i])
            if later:
                index[rank] = later
                heappush(ranks, rank)
        alive = np.array(alive)
        count = np.add.reduceat(alive, ends - np.diff(ends, prepend=0), dtype=np.int64)
        return [x.tolist() for x in np.split(np.array(token)[alive], np.cumsum(count)[:-1])]

    def ids_of(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each distinct word: its own, or those that the replay leaves."""
        out = [[r] if (r := self.ranks.get(w)) is not None else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        sizes = np.cumsum([len(words[i]) for i in rest], dtype=np.int64)
        for part in np.split(rest, np.flatnonzero(np.diff(sizes // REPLAY_BYTES)) + 1) if rest else ():
            for i, ids in zip(part.tolist(), self.replay([words[i] for i in part]), strict=True):
                out[i] = ids
        return out


class ByteEncoder:
    """Ids of all texts of a block in one array, and how many each has."""

    def __init__(self, merges: Merges, pattern: str, whole_texts: bool = False):
        import regex

        self.merges, self.words_of, self.whole_texts = merges, regex.compile(pattern).findall, whole_texts
        self.code = ChunkCode(self._encode)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [self.words_of(c.decode("utf-8", "replace")) for c in chunks]
        distinct = list(dict.fromkeys(chain.from_iterable(words)))
        ids = dict(zip(distinct, self.merges.ids_of([w.encode() for w in distinct]), strict=True))
        found = [[i for w in ws for i in ids[w]] for ws in words]
        count = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int32, int(count.sum())), count

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        data = block.data
        cut = np.zeros(len(data), bool)
        if not self.whole_texts:
            cut[:-1] = (data[:-1] == 0x20) & _PLAIN[data[1:]]
        doc, starts, ends, hashes = cut_spans(block, cut)
        ids, times = self.code(data, starts, ends, hashes)
        return ids, np.bincount(doc, times, minlength=block.rows).astype(np.int64)


class ByteDecoder:
    """The bytes of all texts in one array, and where each ends."""

    def __init__(self, merges: Merges):
        raw = [b""] * merges.size
        for token, rank in merges.ranks.items():
            raw[rank] = token
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.bytes, self.at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, count: np.ndarray) -> tuple[bytes, list[int]]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id that is no token's")
        times = self.sizes[ids]
        index = np.arange(int(times.sum())) + np.repeat(self.at[ids] - (np.cumsum(times) - times), times)
        return self.bytes[index].tobytes(), np.append(0, np.cumsum(times))[np.append(0, np.cumsum(count))].tolist()


@functools.lru_cache(maxsize=2)
def load(path: str) -> Merges:
    """Read a rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as file:
        return Merges({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder for each Python worker, so that its (bounded) table of chunks serves many tasks."""
    import public_tokenizers

    return ByteEncoder(load(path), pattern, whole_texts=pattern != public_tokenizers.PATTERN)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _lists(ids: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row of docs(doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(path, pattern)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, count = encode(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(count), _lists(ids, count)], names=["doc_id", "n_tokens", "ids"])

    return _slim(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encoded(ids, ...) and the text, as column `decoded` (under a longer name where that is taken)."""
    at, name = encoded.columns.index("ids"), fresh(encoded, "decoded")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = ByteDecoder(load(path))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                column = part.column(at)
                count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                data, ends = decode(column.flatten().to_numpy(), count)
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return encoded.mapInArrow(rows, StructType([*encoded.schema.fields, StructField(name, StringType())]))


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (little-endian, 32 bits) and of the bytes that the ids decode to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = worker_encoder(path, pattern), ByteDecoder(load(path))
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, count = encode(block)
                data, ends = decode(ids, count)
                raw, at = ids.astype("<u4").tobytes(), (4 * np.append(0, np.cumsum(count))).tolist()
                digest = lambda x, cuts: pa.array([hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(count), digest(raw, at), digest(data, ends)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _slim(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
