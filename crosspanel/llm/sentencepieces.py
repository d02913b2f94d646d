"""SentencePiece encoding and decoding by a Viterbi pass over shared prefixes.

Texts are cut into marked words (white space marks the word that follows), further wherever no
piece of the model reaches across. The distinct words of a block are sorted, which is a trie in
depth-first order: the forward states of a word's prefix are those of its predecessor up to their
common prefix and only the rest is computed. A state holds the last piece of the best way to
write the prefix; the way itself is read backwards from the word's end.

For a unigram model the forward score is the largest sum of piece scores. For a BPE model, sums
of scores don't give the model's own segmentation, so there a step counts as possible only where
the merges would leave the two neighbouring pieces apart; for each prefix exactly one last piece
is possible then, and the result is that of the merges, id for id.

Characters outside the vocabulary become byte pieces, or the unknown piece where the model has
none. Decoding joins the pieces, turns marks into spaces and drops the one put in front.

Models are taken whose normalizer leaves texts as they are but for the marks (identity, a space in front, no
white space taken away), as is usual for models with byte pieces; any other is refused with an error, since its ids would be
wrong. User-defined symbols are refused likewise.

Defined cases: null and empty texts have no pieces and decode to the empty text; U+2581 in a text
is taken as a space, as the library does, so that it decodes to a space and round_trip is false; of equal scores the shorter last piece
stays; repeated rows each get a row; a text of any length is encoded whole (one of over 2 MB is a block of its own); an empty table gives an
empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .bytewords import Block, blocks
from .chunks import ChunkCode, cut_spans

MARK = "▁"
_BYTE = np.arange(256)
#: Classes of bytes: 0 other ASCII, 1 letters, 2 digits, 3 the space, 4 outside ASCII.
_CLASS = np.select([_BYTE >= 0x80, _BYTE == 32, (_BYTE >= 48) & (_BYTE <= 57), ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122)], [4, 3, 2, 1], 0)


class Pieces:
    """Vocabulary of a model: pieces with scores in the order of their ids."""

    def __init__(self, pieces: list[str], scores: list[float], plain: list[bool], byte_ids: list[int] | None, unknown: int, bpe: bool):
        """plain: not a control, unknown or byte piece. byte_ids: the ids of the 256 byte pieces."""
        self.pieces, self.scores, self.byte_ids, self.unknown, self.bpe = pieces, scores, byte_ids, unknown, bpe
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.across = np.zeros((5, 5), bool)
        for p in self.ids:
            kind = _CLASS[np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)]
            self.across[kind[:-1], kind[1:]] = True
        self.across[4, 4] = True  # never inside a character
        # Pieces by their characters from the last to the first.
        self.backwards: dict = {}
        for p, i in self.ids.items():
            node = self.backwards
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[None] = i
        if bpe:
            self._learn_merges()
        self.raw = [p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        for value, i in enumerate(byte_ids or []):
            self.raw[i] = bytes([value])

    def _learn_merges(self) -> None:
        """For each piece its two parts in its last merge, as (rank, symbol)s: undone when neighbours are tested."""
        order = sorted(self.ids.values(), key=lambda i: -self.scores[i])
        self.rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.parts: dict[str, tuple[str, str] | None] = {}
        for p in self.ids:
            symbols, last = list(p), None
            while len(symbols) > 1:
                ranked = [(self.rank.get(symbols[k] + symbols[k + 1], 1 << 60), k) for k in range(len(symbols) - 1)]
                rank, k = min(ranked)
                if rank == 1 << 60:
                    break
                last = (symbols[k], symbols[k + 1])
                symbols[k : k + 2] = ["".join(last)]
            self.parts[p] = last if len(symbols) == 1 else None
        self.unreachable = {p for p, x in self.parts.items() if x is None and len(p) > 1}
        self.apart: dict[tuple[int, int], bool] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two pieces as neighbours: undo the latest merge on either
        side, again and again, and see that no earlier merge would have joined across."""
        known = self.apart.get((left, right))
        if known is not None:
            return known
        a, b = self.pieces[left], self.pieces[right]
        before = (1 << 61, 0)  # a merge across matters if it comes before the merge that was undone last
        out = a not in self.unreachable and b not in self.unreachable
        rank, parts = self.rank, self.parts
        while out:
            across = rank.get(a + b)
            if across is not None and (across, 1) < before:
                out = False
                break
            of_a, of_b = parts.get(a), parts.get(b)
            if of_a is None and of_b is None:
                break
            # Of equal merges the left one comes first: in a, then across (1), then in b.
            key_a = (rank[a], 0) if of_a else (-1, 0)
            key_b = (rank[b], 2) if of_b else (-1, 0)
            if key_a > key_b:
                before, a = key_a, of_a[1]
            else:
                before, b = key_b, of_b[0]
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        self.apart[left, right] = out
        return out

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted words; spaces are marks already."""
        out, chars = [], ""
        last: list[int] = [0]  # last piece of each prefix; below -1: -2 - code point of an unknown character
        size: list[int] = [0]  # its characters
        score: list[float] = [0.0]
        worst = min(self.scores, default=0.0) - 10
        for word in words:
            common, most = 0, min(len(chars), len(word))
            while common < most and chars[common] == word[common]:
                common += 1
            del last[common + 1 :], size[common + 1 :], score[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                node, at = self.backwards, end
                best, best_size, best_score = -2 - ord(word[end - 1]), 1, 0.0 if self.bpe else score[end - 1] + worst
                while at:
                    node = node.get(word[at - 1])
                    if node is None:
                        break
                    at -= 1
                    piece = node.get(None)
                    if piece is None:
                        continue
                    if self.bpe:  # no scores: exactly one last piece is possible
                        if at == 0 and self.pieces[piece] not in self.unreachable or at and (last[at] < 0 or self.stay_apart(last[at], piece)):
                            best, best_size = piece, end - at
                            break
                    elif score[at] + self.scores[piece] > best_score:
                        best, best_size, best_score = piece, end - at, score[at] + self.scores[piece]
                last.append(best)
                size.append(best_size)
                if not self.bpe:
                    score.append(best_score)
            chars = word
            ids, at = [], len(word)
            while at:
                if last[at] >= 0:
                    ids.append(last[at])
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in reversed(chr(-2 - last[at]).encode())]
                else:
                    ids.append(self.unknown)
                at -= size[at]
            out.append(ids[::-1])
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """Read a model file once in each worker."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    rules, trained = proto.normalizer_spec, proto.trainer_spec
    as_is = rules.add_dummy_prefix and rules.escape_whitespaces and not (rules.remove_extra_whitespaces or rules.precompiled_charsmap or trained.treat_whitespace_as_suffix)
    if not as_is or any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces):
        raise ValueError(f"{path}: a model with this normalizer or with user-defined symbols is not supported")
    if trained.model_type not in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM):
        raise ValueError(f"{path}: neither a BPE nor a unigram model")
    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.IsByte(i) or model.IsControl(i) or model.IsUnknown(i) or model.IsUnused(i) for i in range(n)]
    by_byte = {int(model.IdToPiece(i)[3:5], 16): i for i in range(n) if model.IsByte(i)}
    return Pieces([model.IdToPiece(i) for i in range(n)], [model.GetScore(i) for i in range(n)], [not s for s in special], [by_byte[b] for b in range(256)] if by_byte else None, model.unk_id(), trained.model_type == pb.TrainerSpec.BPE)


class Encoder:
    """Ids of all texts of a block in one array, and how many each has."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.code = pieces, ChunkCode(self._encode)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [c.decode("utf-8", "replace").replace(" ", MARK) for c in chunks]
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list = [None] * len(words)
        for i, ids in zip(order, self.pieces.encode_sorted([words[i] for i in order]), strict=True):
            found[i] = ids
        count = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for ids in found for i in ids), np.int32, int(count.sum())), count

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The block's texts have a space in front, but for empty ones."""
        kind = _CLASS[block.data]
        cut = np.ones(len(block.data), bool)
        cut[1:] = ~self.pieces.across[kind[:-1], kind[1:]]
        doc, starts, ends, hashes = cut_spans(block, cut)
        ids, times = self.code(block.data, starts, ends, hashes)
        return ids, np.bincount(doc, times, minlength=block.rows).astype(np.int64)


def marked(column: pa.Array) -> pa.Array:
    """Texts with spaces for marks and one in front."""
    text = pc.replace_substring(column.fill_null("") if column.null_count else column, MARK, " ")
    return pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise("", text, " "))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces and ids of each row of docs(doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(load(model_path))
        for batch in batches:
            for block in blocks(marked(batch.column(1))):
                ids, count = encode(block)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(count), listed], names=["doc_id", "n_pieces", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_pieces long, ids array<int>")


class Decoder:
    def __init__(self, pieces: Pieces):
        sizes = np.array([len(r) for r in pieces.raw], np.int64)
        self.bytes, self.sizes, self.at = np.frombuffer(b"".join(pieces.raw), np.uint8), sizes, np.cumsum(sizes) - sizes

    def __call__(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        times = self.sizes[ids]
        index = np.arange(int(times.sum())) + np.repeat(self.at[ids] - (np.cumsum(times) - times), times)
        data = self.bytes[index].tobytes()
        ends = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(count)])]
        return [data[a + 1 : b] if data[a : a + 1] == b" " else data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """The columns of encoded(ids, ...) and the decoded text."""
    at = encoded.columns.index("ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(load(model_path))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                column = part.column(at)
                count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                texts = decode(column.flatten().to_numpy(), count)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(rows, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_crc32 (unsigned, of the decoded text) and whether the text came back whole."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        encode, decode = Encoder(pieces), Decoder(pieces)
        for batch in batches:
            marks = pc.fill_null(pc.match_substring(batch.column(1), MARK), False).to_pylist()
            for block in blocks(marked(batch.column(1))):
                ids, count = encode(block)
                texts = decode(ids, count)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids))
                # Against the text as it came: marks in it are lost.
                same = [t == block.text(i)[1:] and not had for i, (t, had) in enumerate(zip(texts, marks[block.first : block.first + block.rows], strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(count), listed, pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids", "decoded_crc32", "round_trip"])

    return source.mapInArrow(rows, "doc_id long, n_pieces long, ids array<int>, decoded_crc32 long, round_trip boolean")
