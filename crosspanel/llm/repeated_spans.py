"""Removal of bytes in strings of 100 bytes or more that occur earlier in the corpus.

A byte goes if some 100-byte string over it also starts earlier (in a document with a smaller
doc_id, or earlier in the same one). Matches never cross documents and are judged on the input.

The collection's Burrows-Wheeler transform and common prefixes are built column by column, one
symbol of every string a round (`column_wise`). Over whole documents that would take as many rounds over everything
as the longest text has bytes, one after the other, so it is done for many small collections of short strings at once, dealt
by content so that equal strings are in one collection:

1. The anchor of a 100-byte string is its 40-byte substring with the least hash (the first of
   equals). Equal strings have equal anchors at equal places. Neighbouring strings mostly share
   an anchor: they form a run of 160 bytes at most, told by its anchor and by a hash of all its bytes (its context).
   A task keeps one occurrence of each context of a block of texts, the earliest; the other
   occurrences are repeats already.
2. Occurrences meet by anchor. All but the earliest of equal contexts are repeats. An anchor with one context has
   no further repeats.
3. The runs of an anchor with several contexts, cut from their texts, are a collection. After at most 160 rounds, strings whose
   common prefix has 100 bytes are equal; all but the earliest are repeats. An anchor with more than HOT
   contexts would make a collection without bound: its single strings are dealt by their hash instead.
4. Each text meets its repeats, and what they cover is removed.

What travels is packed: a row is a compressed block of many occurrences. Buckets of places have about BUCKET_BYTES of text
and are worked through one by one in a partition; texts stream past the places that belong to them. Equal contexts, and strings of hot anchors, are told by 64-bit hashes (a context
also by its anchor's); strings in collections by their bytes.

Defined cases: a null text counts as empty; texts of fewer than 100 bytes lose nothing; a null
doc_id comes before all others; rows with equal doc_id and equal text are one document, each row
with the same result, and rows with equal doc_id and different texts are ordered by a hash of
the text; a text of over 4 MB is worked on in overlapping parts, with the same result; an empty table gives an empty
result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bytewords import SEGMENT, U64, Block, blocks, mix, powers, prefix_hashes, span_hashes
from .column_wise import build, equal_strings
from .store import written

LENGTH, ANCHOR = 100, 40
#: Bytes of text in a bucket and in a partition; contexts of an anchor; bytes of a collection of runs.
BUCKET_BYTES, PARTITION_BYTES, HOT, COLLECTION = 12 << 20, 96 << 20, 4096, 64 << 10
NULL_ID = -(2**63)
COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_POSITION = U64((1 << 24) - 1)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, byte by byte (the high bytes of small numbers vanish), compressed."""
    import zstandard

    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns)
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(raw: bytes, kinds: str) -> list[np.ndarray]:
    import zstandard

    n, planes, at, out = int.from_bytes(raw[:8], "little"), zstandard.ZstdDecompressor().decompress(raw[8:]), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(planes, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel())
        at += n * size
    return out


def _pack_places(doc_id: np.ndarray, tie: np.ndarray, at: np.ndarray, count: np.ndarray, *more: np.ndarray) -> bytes:
    """Places (document, first start, how many starts) with further columns, sorted by place."""
    order = np.lexsort((at, tie, doc_id))
    doc_id, tie, at, count = doc_id[order], tie[order], at[order], count[order]
    with np.errstate(over="ignore"):
        return _pack([np.diff(doc_id, prepend=doc_id[:1] * 0), tie, np.diff(at, prepend=at[:1] * 0), count.astype(np.uint8), *(m[order] for m in more)])


def _unpack_places(raws: list[bytes], more: str = "") -> list[np.ndarray]:
    parts = []
    for raw in raws:
        doc_id, tie, at, count, *rest = _unpack(raw, "lIIB" + more)
        with np.errstate(over="ignore"):
            parts.append([np.cumsum(doc_id, dtype=np.int64), tie, np.cumsum(at, dtype=np.uint32), count, *rest])
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in "lIIB" + more]


def _least(packed: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbouring values."""
    have, out = 1, packed
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(packed) - width + 1], out[width - have : width - have + len(packed) - width + 1])


def _segments(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start in the block, bytes, offsets): one for a usual block; a long text in overlapping parts."""
    if len(block.data) <= 2 * SEGMENT:
        yield 0, block.data, block.offsets
        return
    for at in range(0, len(block.data) - LENGTH + 1, SEGMENT):  # a block this long is a single text
        data = block.data[at : at + SEGMENT + LENGTH - 1]
        yield at, data, np.array([0, len(data)])


def runs(block: Block) -> tuple[np.ndarray, ...]:
    """doc, first start in the document, starts, anchor hash and context hash of each run of 100-byte strings."""
    parts = []
    for base, data, offsets in _segments(block):
        if len(data) < LENGTH:
            continue
        prefix = prefix_hashes(data)
        grams = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * powers(len(data) + 1, inverse=True)[: len(data) - ANCHOR + 1])
        anchor = (_least((grams & ~_POSITION) | np.arange(len(grams), dtype=U64), LENGTH - ANCHOR + 1) & _POSITION).astype(np.int64)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
        starts = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= offsets[1:][doc])
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[starts[1:]] != anchor[starts[:-1]]) | (doc[starts[1:]] != doc[starts[:-1]])
        first = starts[new]
        count = np.diff(np.append(np.flatnonzero(new), len(starts)))
        context = mix(span_hashes(prefix, first, first + count - 1 + LENGTH) ^ mix((anchor[first] - first + 1).astype(U64)))
        parts.append((doc[first], first - offsets[doc[first]] + base, count, grams[anchor[first]], context))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _by_bucket(bucket: np.ndarray, kind: int, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        rows = order[a:b]
        yield int(bucket[rows[0]]), kind, _pack_places(*(c[rows] for c in columns))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "raw"])


_BLOBS = "bucket long, kind int, raw binary"
REPEAT, LOOK, OCCURRENCE, RUN, TEXT = 0, 1, 2, 3, 9


def _home(doc_id: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document's text; _home_column says the same."""
    with np.errstate(over="ignore"):
        return (doc_id + tie.astype(np.int64)) % n


def _home_column(n: int):
    return F.pmod(F.col("doc_id") + F.col("tie"), F.lit(n))


def _firsts(keys: list[np.ndarray], doc_id: np.ndarray, tie: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest row for each key, ordered by key; all rows at a later place).

    Equal rows of the table are one document: a second row at the earliest place is neither.
    """
    order = np.lexsort((at, tie, doc_id, *reversed(keys)))
    first = np.zeros(len(order), bool)
    first[:1] = True
    for key in keys:
        first[1:] |= key[order[1:]] != key[order[:-1]]
    kept = order[first]
    head = kept[np.cumsum(first) - 1]
    later = (doc_id[order] != doc_id[head]) | (tie[order] != tie[head]) | (at[order] != at[head])
    return kept, order[later]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): COLUMNS."""
    return _cleaned(docs, COLUMNS, lambda doc_id, text, cuts: (doc_id, len(text), *_removal(text, cuts)))


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the maximal removed runs of bytes, from start up to end, of each row."""

    def spans(text: bytes, cuts: np.ndarray) -> list[dict[str, int]]:
        edges = np.flatnonzero(np.diff(cuts.astype(np.int8), prepend=0, append=0))
        return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]

    return _cleaned(docs, "doc_id long, spans array<struct<start:long,end:long>>", lambda doc_id, text, cuts: (doc_id, spans(text, cuts)))


def _removal(text: bytes, cuts: np.ndarray) -> tuple[int, int, str]:
    kept = np.frombuffer(text, np.uint8)[~cuts].tobytes()
    spans = int((np.diff(cuts.astype(np.int8), prepend=0) == 1).sum())
    return int(cuts.sum()), spans, hashlib.sha256(kept).hexdigest()


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of the text, all columns kept; texts of which nothing is left go.

    A cut inside a character takes the rest of the character too. n_chars, where there is such a
    column, becomes the length of the new text. Null and empty texts stay as they are.
    """
    others = [c for c in docs.columns if c != "text"]
    bare, missing = F.coalesce(F.col("text") == "", F.lit(True)), F.col("text").isNull()
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], bare.alias("bare"), missing.alias("missing"))
    cleaned = _cleaned(docs, "cleaned string", lambda doc_id, text, cuts: (np.frombuffer(text, np.uint8)[~cuts].tobytes().decode("utf-8", "ignore"),), rest)
    text = F.when(~F.col("rest.missing"), F.col("cleaned"))
    new = {c: F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)} | {"text": text.alias("text")}
    if "n_chars" in others:
        at = others.index("n_chars")
        new["n_chars"] = F.when(F.col("rest.bare"), F.col(f"rest.c{at}")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cleaned.where(F.col("rest.bare") | (F.col("cleaned") != "")).select(*[new[c] for c in docs.columns])


def _tie(text):
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2**32))


def _pack_runs(columns: list[np.ndarray], texts: list[bytes]) -> bytes:
    """Runs (place, anchor) and their bytes; columns are in order of place already."""
    import zstandard

    places = _pack_places(*columns)
    return len(places).to_bytes(8, "little") + places + zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def _unpack_runs(raws: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard

    cut = [8 + int.from_bytes(r[:8], "little") for r in raws]
    places = _unpack_places([r[8:c] for r, c in zip(raws, cut, strict=True)], "L")
    return places, np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r[c:]) for r, c in zip(raws, cut, strict=True)), np.uint8)


def _collections(anchor: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of runs in collections of about COLLECTION bytes; runs of one anchor stay together."""
    order = np.argsort(anchor, kind="stable")
    ends = np.append(np.flatnonzero(anchor[order][1:] != anchor[order][:-1]) + 1, len(order))
    filled, begin = np.cumsum(size[order]), 0
    while begin < len(order):
        done = filled[begin - 1] if begin else 0
        to = int(ends[np.searchsorted(ends, np.searchsorted(filled, done + COLLECTION, "right"), "right").clip(max=len(ends) - 1)])
        if to > begin + 1 and filled[to - 1] - done > 2 * COLLECTION:  # leave the last, large anchor to the next collection
            at = int(np.searchsorted(ends, to)) - 1
            if at >= 0 and ends[at] > begin:
                to = int(ends[at])
        yield order[begin:to]
        begin = to


def _cleaned(docs: DataFrame, schema: str, make, rest=None) -> DataFrame:
    """A row of `schema` for each row of docs, by make(doc_id, text, which bytes go); `rest`, a column of docs, is carried along with the text."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), _tie(F.col("text")).alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // PARTITION_BYTES) + 1)
    n = parts * (int(total // (parts * BUCKET_BYTES)) + 1)  # buckets

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32)
            for block in blocks(batch.column(2)):
                doc, at, count, anchor, context = runs(block)
                doc_id, tie_of, at = ids[block.first + doc], ties[block.first + doc], at.astype(np.uint32)
                kept, rest = _firsts([context], doc_id, tie_of, at)
                out = list(_by_bucket((anchor[kept] >> U64(32)).astype(np.int64) % n, OCCURRENCE, [doc_id[kept], tie_of[kept], at[kept], count[kept], anchor[kept], context[kept]]))
                out += _by_bucket(_home(doc_id[rest], tie_of[rest], n), REPEAT, [doc_id[rest], tie_of[rest], at[rest], count[rest]])
                if out:
                    yield _batch(out)

    found = written(source.mapInArrow(scan, _BLOBS), "runs")

    def repeats_of(doc_id, tie_of, at, count) -> list[tuple[int, int, bytes]]:
        return list(_by_bucket(_home(doc_id, tie_of, n), REPEAT, [doc_id, tie_of, at, count]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of contexts: later ones are repeats; anchors of several contexts need a look at the texts."""
        for raws in _buckets(batches):
            doc_id, tie_of, at, count, anchor, context = _unpack_places(raws, "LL")
            kept, rest = _firsts([anchor, context], doc_id, tie_of, at)
            out = repeats_of(doc_id[rest], tie_of[rest], at[rest], count[rest])
            _, of, times = np.unique(anchor[kept], return_inverse=True, return_counts=True)
            look = kept[times[of] > 1]
            hot = (times[of] > HOT)[times[of] > 1]
            out += _by_bucket(_home(doc_id[look], tie_of[look], n), LOOK, [doc_id[look], tie_of[look], at[look], count[look], anchor[look], hot.astype(np.uint8)])
            if out:
                yield _batch(out)

    def meet_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Single strings by their hash."""
        for raws in _buckets(batches):
            doc_id, tie_of, at, count, key = _unpack_places(raws, "L")
            _, rest = _firsts([key], doc_id, tie_of, at)
            out = repeats_of(doc_id[rest], tie_of[rest], at[rest], count[rest])
            if out:
                yield _batch(out)

    def meet_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of bytes: each collection's transform and common prefixes tell which strings are equal."""
        for raws in _buckets(batches):
            (doc_id, tie_of, at, count, anchor), data = _unpack_runs(raws)
            size = count.astype(np.int64) + LENGTH - 1
            begin = np.cumsum(size) - size
            out: list[tuple[int, int, bytes]] = []
            for rows in _collections(anchor, size):
                bytes_of = np.concatenate([data[begin[i] : begin[i] + size[i]] for i in rows])
                string, start, group = equal_strings(build(bytes_of, size[rows]), size[rows], LENGTH)
                run = rows[string]
                ids, ties, starts = doc_id[run], tie_of[run], (at[run] + start).astype(np.uint32)
                _, rest = _firsts([group], ids, ties, starts)
                out += repeats_of(ids[rest], ties[rest], starts[rest], np.ones(len(rest), np.uint8))
            if out:
                yield _batch(out)

    def bucketed(blobs: DataFrame) -> DataFrame:
        """A partition's buckets one after the other, their places before their texts."""
        return blobs.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket", "kind")

    of_kind = lambda blobs, kind: bucketed(blobs.where(F.col("kind") == kind)).select("bucket", "raw")
    by_anchor = written(of_kind(found, OCCURRENCE).mapInArrow(meet, _BLOBS), "by_anchor")

    def with_texts(blobs: DataFrame, of: DataFrame) -> DataFrame:
        fields = of.schema.fields
        texts = of.select(_home_column(n).alias("bucket"), F.lit(TEXT).alias("kind"), F.lit(None).cast("binary").alias("raw"), *of.columns)
        places = blobs.select("bucket", F.lit(0).alias("kind"), "raw", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        return bucketed(places.union(texts)).select("bucket", "raw", *of.columns)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc_id, tie_of, at, count, anchor, hot), texts_of in _with_places(batches, "LB"):
            rows: list[tuple[int, int, bytes]] = []
            hashes, places, runs_of, bytes_of = [], [], [], []
            for i, _, _, text, _ in texts_of:
                if not len(i):
                    continue
                cold, warm = i[hot[i] == 0], i[hot[i] == 1]
                runs_of.append(cold)
                bytes_of += [text[a : a + c + LENGTH - 1] for a, c in zip(at[cold].tolist(), count[cold].tolist(), strict=True)]
                data = np.frombuffer(text, np.uint8)
                for a in range(0, max(1, len(data) - LENGTH + 1), SEGMENT) if len(warm) else ():
                    use = warm[(at[warm] >= a) & (at[warm] < a + SEGMENT)]
                    if len(use):
                        times = count[use].astype(np.int64)
                        start = np.repeat(at[use].astype(np.int64), times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        part = data[a : a + SEGMENT + 2 * LENGTH]
                        hashes.append(span_hashes(prefix_hashes(part), start - a, start - a + LENGTH))
                        places.append((np.full(len(start), doc_id[use[0]]), np.full(len(start), tie_of[use[0]]), start.astype(np.uint32)))
            if hashes:
                key = np.concatenate(hashes)
                ids, ties, starts = (np.concatenate(c) for c in zip(*places, strict=True))
                one = np.ones(len(key), np.uint8)
                kept, rest = _firsts([key], ids, ties, starts)
                rows += _by_bucket((key[kept] >> U64(8)).astype(np.int64) % n, OCCURRENCE, [ids[kept], ties[kept], starts[kept], one[kept], key[kept]])
                rows += repeats_of(ids[rest], ties[rest], starts[rest], one[rest])
            if bytes_of:
                of = np.concatenate(runs_of)
                bucket = (anchor[of] >> U64(32)).astype(np.int64) % n
                order = np.lexsort((at[of], tie_of[of], doc_id[of], bucket))
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                    take = order[a:b]
                    r = of[take]
                    rows.append((int(bucket[take[0]]), RUN, _pack_runs([doc_id[r], tie_of[r], at[r], count[r], anchor[r]], [bytes_of[k] for k in take])))
            if rows:
                yield _batch(rows)

    looked = written(with_texts(by_anchor.where(F.col("kind") == LOOK), source).mapInArrow(look, _BLOBS), "looked")
    by_string = written(of_kind(looked, OCCURRENCE).mapInArrow(meet_strings, _BLOBS), "by_string")
    by_run = written(of_kind(looked, RUN).mapInArrow(meet_runs, _BLOBS), "by_run")

    made = StructType.fromDDL(schema)
    if rest is not None:
        source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), _tie(F.col("text")).alias("tie"), F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))
        made = made.add(source.schema["rest"])
    fields = to_arrow_schema(made)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, at, count), texts_of in _with_places(batches, "", every=True):
            out: list[tuple] = []
            for i, own_id, _, text, carried in texts_of:
                edges = np.zeros(len(text) + 1, np.int32)
                np.add.at(edges, at[i], 1)
                np.add.at(edges, at[i].astype(np.int64) + count[i] - 1 + LENGTH, -1)
                row = make(None if own_id == NULL_ID else own_id, text, np.cumsum(edges[:-1]) > 0)
                out.append(row if carried is None else (*row, carried.as_py()))
                if len(out) == 1000:
                    yield _rows(out, fields)
                    out = []
            yield _rows(out, fields)

    repeats = found.union(by_anchor).union(looked).union(by_string).union(by_run).where(F.col("kind") == REPEAT)
    return with_texts(repeats, source).mapInArrow(cut, made)


def _rows(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=fields)


def _with_places(batches: Iterator[pa.RecordBatch], more: str, every: bool = False):
    """For each bucket of batches (bucket, raw, doc_id, tie, text), sorted with the places before the texts: the places'
    columns and an iterator over the texts, (rows of its places, doc_id, tie, text, what is carried with it), each once or, for `every`, for every row.
    """

    def flat():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True)

    for _, group in itertools.groupby(flat(), key=lambda r: r[0]):
        raws, first = [], None
        for row in group:
            if row[4].is_valid:
                first = row
                break
            raws.append(row[1].as_py())
        if first is None or not (raws or every):
            continue
        places = _unpack_places(raws, more)
        yield places, _texts(itertools.chain([first], group), places[0], places[1], every)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The packed rows of each bucket, of batches sorted by bucket."""
    held: list[bytes] = []
    last = None
    for batch in batches:
        for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != last and held:
                yield held
                held = []
            last = bucket
            held.append(raw.as_py())
    if held:
        yield held


def _texts(rows, doc_id: np.ndarray, tie: np.ndarray, every: bool):
    order = np.lexsort((tie, doc_id))
    key = {}
    if len(order):
        edges = np.flatnonzero(np.append(True, (doc_id[order][1:] != doc_id[order][:-1]) | (tie[order][1:] != tie[order][:-1])))
        for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
            key[int(doc_id[order[a]]), int(tie[order[a]])] = order[a:b]
    none, seen = np.zeros(0, np.int64), set()
    for _, _, own_id, own_tie, text, *carried in rows:
        own = own_id.as_py(), own_tie.as_py()
        if every or own in key and own not in seen:
            seen.add(own)
            yield key.get(own, none), *own, text.as_buffer().to_pybytes(), carried[0] if carried else None
