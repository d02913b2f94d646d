"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles of five words (ASCII letters, digits and all beyond ASCII, A-Z folded; a text of fewer
   words has one shingle). A shingle's weight is (1 + ln of its count in the text) * idf, where
   idf = ln(N / df) / ln(HEAVY_SHARE), held between IDF_LOW and 1: shingles in at most one of 256 of the N
   texts count in full, those in one of 16 or more count half. (Without the lower bound, one edited
   word in a text that a third of all rows copy would outweigh everything the copies share.) df is counted
   over all rows. Only shingles in more than one of 256 texts need an entry, and there are at most 256 times the mean number of
   shingles of a text; they are found exactly: a shingle as frequent as that has at least half
   that share in some group of rows of a task, so first the sums of such local counts and then
   exact counts of the few candidates decide.
2. Consistent weighted samples, 64 of each text: for each shingle with weight w,
   t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)), the least a wins and (shingle, t)
   is the sample. A text with few shingles draws all samples from all its shingles; one with
   many deals its shingles to 64 bins by their hash and draws one from each (an empty bin borrows
   from another by a fixed probing order). In an overlap of sizes both kinds are drawn, so that
   no pair of similar texts is told apart by its kind.
3. Sixteen bands of four samples. Texts with the same words are one node. Each node of a band bucket
   is compared with the bucket's least node, first by their samples, then by the texts: a star, with
   as many pairs as members. The links found join most of what belongs together, groups of any
   size included.
4. What a star leaves open are pairs of a bucket whose nodes are not in one component yet. Of such a
   bucket the largest component is one side and all other nodes are compared among themselves and
   with that side, in blocks of bounded size, by their samples; the components of the pairs that agree
   in ESTIMATE of their samples are compared in the same way by their texts. A block's links are a spanning forest, never all pairs.
5. Weighted Jaccard similarity of the texts, 0.8 or more, alone makes a link. Classes are the
   components of the links.

Defined cases: null, empty and wordless texts are in classes of their own; repeated rows are
copies; a doc_id that comes again with another text is another document; of ties the row with the least (doc_id,
hash of text) is kept; a null doc_id is a document like any other (a class of such documents only has class_id
null); a text of any length is one node, its shingles sorted in memory (40 bytes a word); an empty table
gives an empty result; other columns, whatever their names, play no part and are kept by one_of_each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, LOWER, U64, Block, blocks, mix, window_hashes, words
from .components import connected_components
from .store import fresh, written

SHINGLE, SIMILAR, SAMPLES, BANDS, HEAVY_SHARE, IDF_LOW = 5, 0.8, 64, 16, 256, 0.5
#: Up to a weight of MANY a text draws from all its shingles; from FEW on it deals to bins. FEW < 0.8 * MANY.
MANY, FEW = 192, 150
ESTIMATE, BUCKET_BLOCK, TEXT_BLOCK = 0.6, 512, 256
GROUP = 2048  # rows over which a task counts before it looks for frequent shingles


def _mod(x: np.ndarray, n: int) -> np.ndarray:
    return (x % U64(n)).astype(np.int64)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Shingles:
    """Distinct shingles of each text of a block: hashes ascending within each text, counts, and each text's slice."""

    def __init__(self, block: Block, size: int = SHINGLE):
        found = words(block, ALNUM, LOWER)
        self.n_words = found.per_doc(block.rows)
        hashes, at = window_hashes(found.hashes, found.doc, size)
        doc = found.doc[at]
        begin = np.concatenate([[0], np.cumsum(self.n_words)])
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < size))
        place = np.arange(len(found.doc)) - begin[found.doc]
        weight = mix(place.astype(U64) + U64(1)) | U64(1)
        whole = np.zeros(block.rows, U64)
        np.add.at(whole, found.doc, mix(found.hashes) * weight)
        #: One value for all texts with the same words.
        self.node = mix(whole + self.n_words.astype(U64)).view(np.int64)
        hashes, doc = np.concatenate([hashes, mix(whole[short])]), np.concatenate([doc, short])
        order = np.argsort(hashes, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        hashes, doc = hashes[order], doc[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(first)
        self.hashes, self.doc = hashes[start], doc[start]
        self.count = np.diff(np.append(start, len(hashes)))
        self.begin = np.searchsorted(self.doc, np.arange(block.rows + 1))

    def weights(self, idf: Idf) -> np.ndarray:
        return idf(self.hashes) * (1 + np.log(self.count))


class Idf:
    """Weights of shingles: an entry for each frequent one."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, total: int):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.clip(np.log(np.maximum(total, 1) / df[order]) / np.log(HEAVY_SHARE), IDF_LOW, 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes))
        if len(self.keys):
            at = np.searchsorted(self.keys, hashes)
            at[at == len(self.keys)] = 0
            same = self.keys[at] == hashes
            out[same] = self.values[at[same]]
        return out


def frequent_shingles(docs: DataFrame) -> Idf:
    total = docs.count()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            some = n >= rows / (2 * HEAVY_SHARE)
            return pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some])], names=["shingle", "n"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                parts.append(Shingles(block).hashes)
                rows += block.rows
                if rows >= GROUP:
                    yield flush()
                    parts, rows = [], 0
        if parts:
            yield flush()

    local = docs.select("text").mapInArrow(candidates, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    # At most 2 * HEAVY_SHARE * (mean shingles of a text) rows, whatever the number of texts.
    keys = np.array(sorted(r["shingle"] for r in local.where(F.col("n") >= total / (2 * HEAVY_SHARE)).select("shingle").collect()), np.int64).view(U64)
    keys = np.sort(keys)
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        n = np.zeros(len(keys), np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                hashes = Shingles(block).hashes
                at = np.searchsorted(keys, hashes)
                at[at == len(keys)] = 0
                n += np.bincount(at[keys[at] == hashes], minlength=len(keys))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys[seen].view(np.int64)), pa.array(n[seen])], names=["shingle", "n"])

    if not len(keys):
        return Idf(keys, np.zeros(0), total)
    exact = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= total / HEAVY_SHARE).collect()
    return Idf(np.array([r["shingle"] for r in exact], np.int64).view(U64), np.array([r["n"] for r in exact], float), total)


def _draw(hashes: np.ndarray, log_weight: np.ndarray, salt) -> tuple[np.ndarray, np.ndarray]:
    """ln a and the sample of each shingle under the hash function `salt`."""
    x = mix(hashes ^ mix(np.asarray(salt, U64)))
    y = mix(x + U64(0x632BE59BD9B4E019))
    # Gamma(2, 1) variables from products of two uniform ones; each 64-bit value gives two.
    low, high = U64(0xFFFFFFFF), U64(32)
    unit = lambda v: (v.astype(np.float64) + 0.5) * 2.0**-32
    r = -np.log(unit(x & low) * unit(x >> high))
    log_c = np.log(-np.log(unit(y & low) * unit(y >> high)))
    b = _uniform(mix(y))
    t = np.floor(log_weight / r + b)
    return log_c - r * (t - b) - r, mix(x ^ t.astype(np.int64).view(U64))


def _full(hashes: np.ndarray, log_weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """All SAMPLES of each text from all its shingles; begin: where each (non-empty) text begins."""
    out = np.empty((len(begin), SAMPLES), U64)
    size = np.diff(np.append(begin, len(hashes)))
    owner = np.repeat(np.arange(len(begin)), size)
    for k in range(SAMPLES):
        a, sample = _draw(hashes, log_weight, k + 1)
        least = np.minimum.reduceat(a, begin)
        win = np.flatnonzero(a == least[owner])
        out[owner[win], k] = sample[win]
    return out


def _binned(hashes: np.ndarray, log_weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One sample from each of SAMPLES bins of each text; empty bins borrow."""
    a, sample = _draw(hashes, log_weight, 0)
    cell = owner * SAMPLES + _mod(mix(hashes + U64(77)), SAMPLES)
    least = np.full(n * SAMPLES, np.inf)
    np.minimum.at(least, cell, a)
    win = a == least[cell]
    out = np.zeros(n * SAMPLES, U64)
    out[cell[win]] = sample[win]
    filled = np.isfinite(least).reshape(n, SAMPLES)
    out = out.reshape(n, SAMPLES)
    source, done = out.copy(), filled.copy()
    attempt = 0
    while not done.all():
        attempt += 1
        probe = _mod(mix(np.arange(SAMPLES, dtype=U64) * U64(1_000_003) + U64(attempt)), SAMPLES)
        row, col = np.nonzero(~done & filled[:, probe])
        out[row, col] = mix(source[row, probe[col]] + U64(attempt))
        done[row, col] = True
    return out


def signatures(block: Block, idf: Idf) -> tuple[Shingles, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The shingles, and for either kind (rows, band keys, samples cut to bytes)."""
    sh = Shingles(block)
    weight = sh.weights(idf)
    log_weight = np.log(weight)
    total = np.bincount(sh.doc, weight, minlength=block.rows)
    out = []
    for kind, chosen in ((0, (total > 0) & (total <= MANY)), (1, total >= FEW)):
        rows = np.flatnonzero(chosen)
        if not len(rows):
            out.append((rows, np.zeros((0, BANDS), np.int64), np.zeros((0, SAMPLES), np.uint8)))
            continue
        use = chosen[sh.doc]
        owner = (np.cumsum(chosen) - 1)[sh.doc[use]]
        if kind:
            got = _binned(sh.hashes[use], log_weight[use], owner, len(rows))
        else:
            got = _full(sh.hashes[use], log_weight[use], np.searchsorted(owner, np.arange(len(rows))))
        per = SAMPLES // BANDS
        keys = np.zeros((len(rows), BANDS), U64)
        for k in range(per):
            keys = mix(keys * U64(31) + got[:, k::per])
        keys = mix(keys ^ mix(np.arange(BANDS, dtype=U64) + U64(1000 + 100 * kind)))
        out.append((rows, keys.view(np.int64), (got & U64(0xFF)).astype(np.uint8)))
    return sh, out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows that agree in the first columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts = [0, *edges.tolist(), batch.num_rows]
        if last is not None and (key[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _blocked(members: DataFrame, group: str, size: int) -> DataFrame:
    """members(group, node, comp, ...), each row once for each block it takes part in; lo, hi and chunk are added.

    Of each group the largest component is one side, dealt to chunks of about `size` rows, and all
    other nodes are the other side. There is a block for every two chunks of the other side and for each of its chunks with one of the
    largest component; so every two nodes of different components meet, and a group that is one component has no block.
    """
    sides = members.groupBy(group, "comp").agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"))
    chunks = lambda n: F.ceil(n / size).cast("int")
    others = F.col("n") - F.col("most.n")
    sides = written(sides.where(others > 0).select(group, F.col("most.comp").alias("largest"), chunks(others).alias("c_other"), chunks(F.col("most.n")).alias("c_largest")), "sides")
    spread = F.xxhash64("node", group)
    is_large = F.col("comp") == F.col("largest")
    chunk = F.when(is_large, F.col("c_other") + F.pmod(spread, F.col("c_largest"))).otherwise(F.pmod(spread, F.col("c_other"))).cast("int")
    with_blocks = F.col("c_other") + F.when(is_large, 0).otherwise(F.col("c_largest"))
    dealt = members.join(sides, group).withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), with_blocks - 1)))
    return dealt.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "largest", "c_other", "c_largest")


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the pairs of a bucket's block, of different components, that agree in enough samples."""
    out: list[tuple[int, int]] = []
    for table in _runs(batches, 3):
        nodes, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        samples = np.stack([table.column(f"s{i}").to_numpy() for i in range(8)], axis=1).view(np.uint8)
        chunk, n = table.column("chunk").to_numpy(), len(nodes)
        across = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        left = np.ones(n, bool)
        while left.any():
            todo = [int(np.argmax(left))]
            left[todo[0]] = False
            while todo and left.any():
                i = todo.pop()
                rest = np.flatnonzero(left)
                near = ((samples[rest] == samples[i]).sum(axis=1) >= ESTIMATE * SAMPLES) & (comp[rest] != comp[i])
                if across:
                    near &= chunk[rest] != chunk[i]
                found = rest[near]
                out += [(int(nodes[i]), int(nodes[j])) for j in found]
                todo += found.tolist()
                left[found] = False
        if len(out) > 10_000:
            yield _edge_batch(out)
            out = []
    yield _edge_batch(out)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending hashes, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    shared = float(np.minimum(a[1][both], b[1][at[both]]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)


def _weighted_sets(texts: pa.ChunkedArray, idf: Idf) -> list[tuple[np.ndarray, np.ndarray]]:
    sets = []
    for block in blocks(texts.combine_chunks()):
        sh = Shingles(block)
        weights = sh.weights(idf)
        sets += [(sh.hashes[a:b], weights[a:b]) for a, b in zip(sh.begin[:-1], sh.begin[1:], strict=True)]
    return sets


def _verified(idf_shared, similar: float):
    """Spanning forests of the links of a block, of texts in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = idf_shared.value
        for table in _runs(batches, 3):
            nodes, chunk = table.column("node").to_numpy(), table.column("chunk").to_numpy()
            across = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
            sets = _weighted_sets(table.column("text"), idf)
            total = np.array([s[1].sum() for s in sets])
            _, known = np.unique(table.column("comp").to_numpy(), return_inverse=True)
            forest, out = _Forest(int(known.max()) + 1), []
            for i in range(len(sets) - 1):
                # Sums of weights that differ by more than the threshold rule a link out.
                rest = np.arange(i + 1, len(sets))
                rest = rest[np.minimum(total[rest], total[i]) >= similar * np.maximum(total[rest], total[i]) - 1e-9]
                if across:
                    rest = rest[chunk[rest] != chunk[i]]
                for j in rest.tolist():
                    if forest.root(known[i]) != forest.root(known[j]) and similarity(sets[i], sets[j]) >= similar:
                        forest.join(known[i], known[j])
                        out.append((int(nodes[i]), int(nodes[j])))
            if out:
                yield _edge_batch(out)

    return run


def _star_links(idf_shared, similar: float):
    """Links of each group's first row, the pivot, with its other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = idf_shared.value
        for table in _runs(batches, 2):
            nodes = table.column("node").to_numpy()
            sets = _weighted_sets(table.column("text"), idf)
            out = [(int(nodes[0]), int(n)) for n, s in zip(nodes[1:], sets[1:], strict=True) if similarity(sets[0], s) >= similar]
            if out:
                yield _edge_batch(out)

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, samples of a, samples of b) the pairs that agree in enough samples."""
    for batch in batches:
        side = lambda k, batch=batch: np.stack([batch.column(2 + 8 * k + i).to_numpy() for i in range(8)], axis=1).view(np.uint8)
        near = (side(0) == side(1)).sum(axis=1) >= ESTIMATE * SAMPLES if batch.num_rows else np.zeros(0, bool)
        yield batch.select([0, 1]).filter(pa.array(near))


def _row() -> Column:
    """Tells rows apart: by doc_id (if there is one) and by text, as a doc_id may come again with another text."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"), F.xxhash64("text").alias("copy"))


def near_duplicate_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size, node_size (texts with the same words) and kept for each row of docs(doc_id, text)."""
    classes = _classes(docs, similar)
    return classes.select("doc_id", "class_id", "class_size", "kept")


def _classes(docs: DataFrame, similar: float) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    row = _row()
    idf = spark.sparkContext.broadcast(frequent_shingles(docs))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                sh, kinds = signatures(block, idf.value)
                nothing = sh.n_words == 0
                marks = [batch.column(i).slice(block.first, block.rows) for i in range(3)]
                where = [np.flatnonzero(nothing), *(k[0] for k in kinds)]
                for kind, at in enumerate(where):
                    index = pa.array(at)
                    # A text that has both kinds is one row of the result: the second is marked.
                    extra = np.zeros(len(at), bool) if kind < 2 else np.isin(at, where[1])
                    keys = kinds[kind - 1][1] if kind else np.zeros((len(at), 0), np.int64)
                    cut = np.ascontiguousarray(kinds[kind - 1][2]).view(np.int64) if kind else np.zeros((len(at), 8), np.int64)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([*(m.take(index) for m in marks), pa.array(sh.node[at]), pa.array(extra), pa.array(nothing[at]), listed, *(pa.array(cut[:, i].copy()) for i in range(8))], names=names)

    samples = [f"s{i}" for i in range(8)]
    names = ["doc_id", "id", "copy", "node", "extra", "wordless", "keys", *samples]
    signs = docs.select("doc_id", row.alias("row"), "text").select("doc_id", "row.id", "row.copy", "text").mapInArrow(sign, "doc_id long, id long, copy long, node long, extra boolean, wordless boolean, keys array<long>, " + ", ".join(f"{s} long" for s in samples))
    signed = written(signs.select("doc_id", F.struct("id", "copy").alias("row"), *names[3:]), "signatures")

    # One row for each node and kind, then its bands; buckets of one node end here.
    nodes = signed.where("not wordless").groupBy("node", "extra").agg(F.first("keys").alias("keys"), *[F.first(s).alias(s) for s in samples])
    nodes = written(nodes, "nodes")
    bands = nodes.select("node", "extra", F.explode("keys").alias("key"))
    # Written, so that the joins below have plain exchanges on both sides and a hot bucket can be split.
    full = written(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").drop("n"), "buckets")
    members = written(bands.join(full, "key"), "members")
    sketches = nodes.drop("keys")

    # One text for each node that shares a bucket.
    chosen = signed.where("not wordless").groupBy("node").agg(F.min("row").alias("row"))
    wanted = members.select("node").distinct().join(chosen, "node")
    texts = written(docs.select(row.alias("row"), "text").join(wanted, "row").dropDuplicates(["node"]).select("node", "text"), "texts")

    # The star of each bucket, first by samples, then by texts.
    named = lambda side: sketches.select(F.col("node").alias(side), "extra", *[F.col(s).alias(f"{side}_{s}") for s in samples])
    pairs = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "extra").distinct()
    sampled = pairs.join(named("a"), ["a", "extra"]).join(named("b"), ["b", "extra"]).select("a", "b", *[f"{side}_{s}" for side in "ab" for s in samples])
    star = written(sampled.mapInArrow(_agreeing, "a long, b long").distinct(), "star")
    parts = written(star.groupBy("a").agg(F.ceil(F.count("*") / TEXT_BLOCK).cast("int").alias("parts")), "pivots")
    ends = star.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("place"), F.col("b").alias("node")).join(texts, "node")
    heads = parts.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"), F.col("a").alias("node"), "text")
    grouped = heads.unionByName(ends).repartition("a", "part").sortWithinPartitions("a", "part", "place")
    links = written(grouped.select("a", "part", "node", "text").mapInArrow(_star_links(idf, similar), "a long, b long"), "star_links")
    first = written(connected_components(links), "first_labels")

    # Pairs of a bucket, and then of candidates, that are in different components so far.
    comp = F.coalesce("label", "node").alias("comp")
    labelled = members.select("key", "node", "extra").join(first, "node", "left").select("key", "node", "extra", comp)
    open_ = _blocked(labelled, "key", BUCKET_BLOCK).join(sketches, ["node", "extra"])
    ordered = open_.select("key", "lo", "hi", "node", "chunk", "comp", *samples).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    near = written(connected_components(ordered.mapInArrow(_estimated, "a long, b long")), "candidates").withColumnRenamed("label", "group")
    grouped = near.join(first, "node", "left").select("group", "node", comp)
    blocked = _blocked(grouped, "group", TEXT_BLOCK).join(texts, "node")
    ordered = blocked.select("group", "lo", "hi", "node", "chunk", "comp", "text").repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")
    late = ordered.mapInArrow(_verified(idf, similar), "a long, b long")
    labels = written(connected_components(links.union(late)), "labels")

    rows = signed.where("not extra").select("doc_id", "row", F.when(F.col("wordless"), F.xxhash64("row", F.lit("wordless"))).otherwise(F.col("node")).alias("node"))
    labelled = written(rows.join(labels, "node", "left").select("doc_id", "row", F.coalesce("label", "node").alias("label")), "labelled")
    summary = written(labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min("row").alias("first_row")), "classes")
    return labelled.join(summary, "label").select("doc_id", "row", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("kept"))


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class, all its columns kept."""
    row = fresh(docs, "row")
    kept = _classes(docs, similar).where("kept").select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, _row()).join(kept, row, "left_semi").dropDuplicates([row]).drop(row)
