"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ten consecutive words (a shorter item is one window). A
window occurs in a text only if all its words do, so its prefix under the order "rarest word
first" is a single word: the window's rarest one in the corpus. Texts are joined with windows on
that word alone; the place of the word in the window gives the one position where the window
could begin (positional bound), the ends of the text bound its length, and a rolling hash over
the window's words and then the words themselves decide.

The benchmark goes to the tasks in pieces of at most about `piece_bytes` of text, whatever its size; each
piece's windows are cut, sent, matched against all texts in one pass and dropped before the next piece is read, so that the driver and
the workers hold one piece at a time.

Defined cases: null and empty texts have no words and no hits; items without words have no
windows; items with equal texts are each reported; rows that repeat (same doc_id) each get
their own row, keyed by the row and not by doc_id; items with a null item_id hit like any other but
are left out of the list; of equally rare words the least in byte order is the prefix, which decides no result; a text of any length is matched whole
(one of over 2 MB is a block of its own); empty tables give no hits or an empty result; other columns, whatever their names, play no
part and are kept by clean_documents.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, LOWER, U64, Block, Words, blocks, mix, words
from .store import written

WINDOW = 10
PIECE_BYTES = 8 << 20
COLUMNS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_Q = U64(0xD1342543DE82EF95)


def _alnum(block: Block) -> Words:
    return words(block, ALNUM, LOWER)


def _pieces(items: DataFrame, piece_bytes: int) -> list[DataFrame]:
    """The items in pieces of bounded size, read one piece's range of rows at a time."""
    sized = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") > 0)
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(-(-total // piece_bytes))
    return [sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) for k in range(count)]


class _Windows:
    """The distinct windows of one piece, sorted by the hash of their rarest word."""

    def __init__(self, items: pd.DataFrame, size: int):
        named = items["item"].notna().to_numpy()
        codes = np.full(len(items), -1)  # of an item without a name
        self.names, codes[named] = np.unique(items["item"][named].to_numpy(str), return_inverse=True)
        column = pa.array(items["text"], pa.string())
        self.spelled: dict[tuple, list[int]] = {}  # words of the window: items that have it
        hashes: dict[bytes, int] = {}
        for block in blocks(column):
            found = _alnum(block)
            lowered = LOWER[block.data]
            spelled = [lowered[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)]
            hashes.update(zip(spelled, found.hashes.tolist(), strict=True))
            begin = np.searchsorted(found.doc, np.arange(block.rows + 1))
            for i in range(block.rows):
                n = begin[i + 1] - begin[i]
                for at in range(begin[i], begin[i + 1] - min(n, size) + (n > 0)):
                    self.spelled.setdefault(tuple(spelled[at : at + min(n, size)]), []).append(int(codes[block.first + i]))
        self.windows = sorted(self.spelled)
        self.items = [np.unique([i for i in self.spelled[w] if i >= 0]).astype(np.int64) for w in self.windows]
        del self.spelled
        self.words = {w: hashes[w] for w in {x for window in self.windows for x in window}}

    def keyed(self, counts: dict[int, int]) -> None:
        """Order each window's words by rarity and keep the first as its prefix."""
        rank = lambda w: (counts.get(self.words[w], 0), w)
        self.place = np.array([min(range(len(w)), key=lambda k: rank(w[k])) for w in self.windows], np.int64)
        self.size = np.array([len(w) for w in self.windows], np.int64)
        key = np.array([self.words[w[p]] for w, p in zip(self.windows, self.place, strict=True)], U64)
        order = np.argsort(key, kind="stable")
        self.windows, self.items = [self.windows[i] for i in order], [self.items[i] for i in order]
        self.place, self.size, key = self.place[order], self.size[order], key[order]
        self.keys, self.begin, self.count = np.unique(key, return_index=True, return_counts=True)
        self.hashes = np.array([_window_hash(np.array([self.words[x] for x in w], U64)) for w in self.windows], U64)


def _q_powers(n: int, inverse: bool = False) -> np.ndarray:
    out = np.full(n, pow(int(_Q), -1, 2**64) if inverse else int(_Q), U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _window_hash(hashes: np.ndarray) -> np.uint64:
    return (hashes * _q_powers(len(hashes))).sum(dtype=U64)


def _occurrences(block: Block, found: Words, win: _Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all places where a window stands."""
    none = np.zeros(0, np.int64)
    if not len(found.hashes) or not len(win.keys):
        return none, none
    at = np.searchsorted(win.keys, found.hashes)
    at[at == len(win.keys)] = 0
    word = np.flatnonzero(win.keys[at] == found.hashes)
    key = at[word]
    # Each found prefix word with each window that has it as its prefix, by position.
    times = win.count[key]
    word = np.repeat(word, times)
    window = np.arange(len(word)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(win.begin[key], times)
    first, size = word - win.place[window], win.size[window]
    last = first + size - 1
    fits = (first >= 0) & (last < len(found.doc))
    first, last, window, size = first[fits], last[fits], window[fits], size[fits]
    whole = found.doc[first] == found.doc[last]
    first, window, size = first[whole], window[whole], size[whole]
    prefix = np.zeros(len(found.hashes) + 1, U64)
    np.cumsum(found.hashes * _q_powers(len(found.hashes)), out=prefix[1:])
    same = (prefix[first + size] - prefix[first]) * _q_powers(len(prefix), inverse=True)[first] == win.hashes[window]
    first, window = first[same], window[same]
    lowered = LOWER[block.data]
    exact = np.array([all(lowered[found.starts[a + k] : found.ends[a + k]].tobytes() == w for k, w in enumerate(win.windows[j])) for a, j in zip(first, window, strict=True)], bool)
    return first[exact], window[exact]


def _word_counts(docs: DataFrame, wanted) -> dict[int, int]:
    """How often each wanted word stands in all texts; at most one row for each comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = wanted.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                hashes = _alnum(block).hashes
                at = np.searchsorted(keys, hashes)
                at[at == len(keys)] = 0
                total += np.bincount(at[keys[at] == hashes], minlength=len(keys))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[seen].view(np.int64)), pa.array(total[seen])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"] % 2**64: r["n"] for r in rows}


class _Matcher:
    """Runs in tasks: hits of a block's texts against one piece of the benchmark."""

    def __init__(self, win):
        self.win = win

    def __call__(self, block: Block) -> tuple[Words, np.ndarray, dict[int, set[str]]]:
        """The words, whether each is hit, and the items of each text that has any."""
        win, found = self.win.value, _alnum(block)
        first, window = _occurrences(block, found, win)
        edges = np.zeros(len(found.doc) + 1, np.int64)
        np.add.at(edges, first, 1)
        np.add.at(edges, first + win.size[window], -1)
        items: dict[int, set[str]] = {}
        for doc, w in zip(found.doc[first].tolist(), window.tolist(), strict=True):
            items.setdefault(doc, set()).update(win.names[win.items[w]].tolist())
        return found, np.cumsum(edges[:-1]) > 0, items


def _matchers(docs: DataFrame, items: DataFrame, size: int, piece_bytes: int) -> Iterator[_Matcher]:
    """One at a time: the caller is done with a matcher before it takes the next."""
    spark = docs.sparkSession
    for piece in _pieces(items, piece_bytes):
        win = _Windows(piece.toPandas(), size)
        if win.windows:
            win.keyed(_word_counts(docs, spark.sparkContext.broadcast(np.unique(np.array(list(win.words.values()), U64)))))
            yield _Matcher(spark.sparkContext.broadcast(win))


def _report(ids: pa.Array, n_words, n_hit, lists: list[list[str]]) -> pa.RecordBatch:
    columns = [ids, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()), pa.array(np.asarray(n_hit) > 0)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])


def benchmark_hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per row of docs(doc_id, text), against items(item_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = _matchers(docs, items, size, piece_bytes)
    found = [m for m in [next(pieces, None)] if m]
    second = next(pieces, None) if found else None
    if second:
        return _hits_by_piece(slim, itertools.chain([*found, second], pieces))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                seen, hit, of = found[0](block) if found else (_alnum(block), None, {})
                n_hit = np.bincount(seen.doc[hit], minlength=block.rows).astype(np.int64) if found else np.zeros(block.rows, np.int64)
                ids = pc.cast(batch.column(0).slice(block.first, block.rows), pa.int64())
                yield _report(ids, seen.per_doc(block.rows), n_hit, [sorted(of.get(i, ())) for i in range(block.rows)])

    return slim.mapInArrow(rows, COLUMNS)


def _hits_by_piece(slim: DataFrame, found: Iterator[_Matcher]) -> DataFrame:
    """For a benchmark of more than one piece: a pass for each, whose hits meet by the text they are in."""
    keyed = slim.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))

    def hits_of(match: _Matcher) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column(1)):
                    seen, hit, of = match(block)
                    begin = np.searchsorted(seen.doc, np.arange(block.rows + 1))
                    docs = sorted(of)
                    places = [np.flatnonzero(hit[begin[i] : begin[i + 1]]).tolist() for i in docs]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first).take(pa.array(docs, pa.int64())), pa.array(places, pa.list_(pa.int64())), pa.array([sorted(of[i]) for i in docs], pa.list_(pa.string()))], names=["key", "hit", "items"])

        out = written(keyed.select("key", "text").mapInArrow(rows, "key string, hit array<long>, items array<string>").dropDuplicates(["key"]), "piece_hits")
        match.win.unpersist()
        return out

    # Written before the join, so that a text of very many rows can be split there.
    hits = reduce(DataFrame.union, map(hits_of, found)).groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = written(hits, "hits")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(block.first, block.rows) for i in (0, 2)] + [pa.array(_alnum(block).per_doc(block.rows))], names=["doc_id", "key", "n_words"])

    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    joined = keyed.select("doc_id", "text", "key").mapInArrow(count, "doc_id long, key string, n_words long").join(hits, "key", "left")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of docs whose text has no hit, with all their columns."""
    out = docs
    for k, match in enumerate(_matchers(docs, items, size, piece_bytes)):
        if k:  # the pass before is done before this piece's begins
            out = written(out, "clean_documents")

        def rows(batches: Iterator[pa.RecordBatch], match=match, text=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column(text)):
                    seen, hit, _ = match(block)
                    bad = np.bincount(seen.doc[hit], minlength=block.rows) > 0
                    yield batch.slice(block.first, block.rows).filter(pa.array(~bad))

        out = out.mapInArrow(rows, docs.schema)
    return out
