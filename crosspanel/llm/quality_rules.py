"""Quality rules by compression bands.

Each whole text, and each fixed chunk of it, is compressed with zstandard. Where the chunks leave
a tail, the text's last CHUNK bytes are one more chunk, so that every byte is judged; a text
shorter than a chunk is its only one. The ratio of compressed to plain bytes falls below that of
prose where a text repeats itself and rises towards one where it is random. Short texts compress
less, so the limits are curves over the length: straight lines in log2(bytes) between the knots
of BAND. A chunk, being one sample of a text, has the limits of its length widened by CHUNK_MARGIN.
A text is rejected if its own ratio is outside, or more than CHUNK_SHARE of its chunks are.

The knots lie outside the ratios of prose (at level 3: 0.54 to 0.72 for 384 bytes, 0.46 to 0.58 for
1.5 kB, 0.43 to 0.47 for 6 kB, 0.40 to 0.45 for 16 kB, 0.36 for a legal text of 35 kB); lists of one
pattern and texts with marks strewn in fall below, letters or base64 without sense rise above.

Defined cases: a null text counts as empty; an empty text fails the base rule (no words), has
ratio null, no chunks and is not kept; a text of any length is compressed whole (one of over 2 MB is a block
of its own); a text of exactly CHUNK bytes is one chunk; repeated rows, and rows with equal doc_ids, each
get their own row; an empty table gives an empty result; other columns of the input, whatever
their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACED, Block, blocks, lines, window_hashes, with_doc, words

#: (bytes, least ratio, largest ratio): the limits' knots.
BAND = ((128, 0.45, 1.20), (384, 0.50, 0.78), (768, 0.45, 0.72), (1536, 0.43, 0.65), (3072, 0.415, 0.60), (6144, 0.395, 0.565), (16384, 0.355, 0.54), (65536, 0.31, 0.52), (1 << 20, 0.26, 0.50))
CHUNK, CHUNK_MARGIN, CHUNK_SHARE, LEVEL = 4096, 0.015, 0.2, 3
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def _counts(block: Block) -> dict[str, np.ndarray]:
    n = block.rows
    found = words(block, SPACED)
    per_doc = lambda where, weights=None: np.bincount(where, weights, minlength=n).astype(np.int64)
    byte_doc = lambda mask: per_doc(np.searchsorted(block.offsets, np.flatnonzero(mask), "right") - 1)
    out = {"n_words": found.per_doc(n), "word_chars": byte_doc(SPACED[block.data] & ((block.data & 0xC0) != 0x80)), "n_symbols": byte_doc(_SYMBOL[block.data])}

    rows = lines(block)
    first_word = np.searchsorted(found.starts, rows.starts)
    worded = np.append(found.starts, np.iinfo(np.int64).max)[first_word] < rows.ends
    doc, hashes = rows.doc[worded], with_doc(rows.hashes[worded], rows.doc[worded])
    _, first = np.unique(hashes, return_index=True)
    out["n_dup_lines"] = per_doc(doc) - per_doc(doc[first])

    windows, at = window_hashes(found.hashes, found.doc, 3)
    _, inverse, count = np.unique(with_doc(windows, found.doc[at]), return_inverse=True, return_counts=True)
    covered = np.zeros(len(found.doc), bool)
    for k in range(3):
        covered[at[count[inverse] > 1] + k] = True
    out["n_repeat_words"] = per_doc(found.doc[covered])
    return out


def limits(size: np.ndarray, band=BAND) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest ratio of a text of so many bytes; constant beyond the first and last knots."""
    knots = np.log2([k[0] for k in band])
    at = np.log2(np.maximum(size, 1))
    return np.interp(at, knots, [k[1] for k in band]), np.interp(at, knots, [k[2] for k in band])


def _ratios(block: Block, level: int, band) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    press = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
    whole, chunks, bad = np.full(block.rows, np.nan), np.zeros(block.rows, np.int64), np.zeros(block.rows, np.int64)
    low, high = (float(x[0]) for x in limits(np.array([CHUNK]), band))
    view = memoryview(np.ascontiguousarray(block.data))
    for i in range(block.rows):
        a, b = int(block.offsets[i]), int(block.offsets[i + 1])
        if a == b:
            continue
        whole[i] = len(press.compress(view[a:b])) / (b - a)
        at_end = [b - CHUNK] if b - a > CHUNK and (b - a) % CHUNK else []
        for at in [*range(a, b - CHUNK + 1, CHUNK), *at_end]:
            share = len(press.compress(view[at : at + CHUNK])) / CHUNK
            chunks[i] += 1
            bad[i] += not low - CHUNK_MARGIN <= share <= high + CHUNK_MARGIN
    return whole, chunks, bad


def quality_rules(docs: DataFrame, level: int = LEVEL, band=BAND, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """One row per row of docs(doc_id, text): the base counts, the compression figures and the verdict."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                base = _counts(block)
                ratio, chunks, bad = _ratios(block, level, band)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                size = np.diff(block.offsets)
                least, most = limits(size, band)
                with np.errstate(invalid="ignore"):
                    within = (ratio >= least) & (ratio <= most)
                short = (size > 0) & (size < CHUNK)
                chunks[short], bad[short] = 1, ~within[short]
                good = within & (bad <= chunk_share * chunks)
                ids = pc.cast(batch.column(0).slice(block.first, block.rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, *map(pa.array, base.values()), pa.array(failed), pa.array(~failed & good), pa.array(ratio, mask=np.isnan(ratio)), pa.array(chunks), pa.array(bad)],
                    names=[c.split()[0] for c in COLUMNS.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, COLUMNS)
