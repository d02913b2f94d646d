"""How filters interact: what each removes in every order of applying them, from counts by mask of failed filters.

A document's verdicts are bits of one number, its mask. Orders are evaluated over the counts of (part, mask), of which there
are 32 for each part at most, so the 120 orders cost the same for any number of documents.

Filter E, copies of a text with a smaller doc_id, goes by partition refinement. All documents begin in classes of equal
length in code points; round after round a class is split by the hash of the next block of the text, and documents alone in
their class drop out. One scan computes the hashes of all blocks (reading costs more than hashing), so rounds move narrow rows
only. What is left at the end is compared by whole text: copies collapse in each task before the shuffle, a
class whose members turn out to be different texts is divided by text, and ids above the least of their text are marked.

A class may hold any share of the rows: classes are counted with partial sums, the counts are written, and the joins with them are
between two plain inputs, which Spark splits where they are skewed.

Defined cases: a null text is empty; a null lang is the part "" (together with lang ""); an empty text has no words (A and E can fail); a null
doc_id is never smaller nor larger than another, so it fails no E, marks none and has no labels; repeated rows count as often as they
stand there and aren't smaller than one another; a document with several rows of labels is good or toxic if one of
them says so; texts of any length are taken whole, as one value in a task's memory; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: First bytes of the blocks; the last block reaches to the end.
EDGES = (0, 512, 16384)
#: Up to so many classes (a few tens of MB) are sent to all executors to pick the texts to compare; more are joined.
BROADCAST_CLASSES = 500_000
LETTERS = "ABCDE"
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "[#$%&*|]"


def block_hash(text: Column, k: int) -> Column:
    """Hash of block k of the text's UTF-8 bytes."""
    size = EDGES[k + 1] - EDGES[k] if k + 1 < len(EDGES) else 2**31 - 1
    return F.xxhash64(F.substring(text.cast("binary"), EDGES[k] + 1, size))


def class_of(text: Column) -> Column:
    """The class that a text is in after the last round."""
    out = F.char_length(text).cast("long")
    for k in range(len(EDGES)):
        out = F.xxhash64(out, block_hash(text, k))
    return out


def _several(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class"), "classes")


def refined_classes(rows: DataFrame) -> DataFrame:
    """Classes with several documents after all rounds, from rows(length, b0, b1, ...)."""
    rows = rows.select(F.col("length").alias("class"), *(f"b{k}" for k in range(len(EDGES))))
    classes = _several(rows)
    for k in range(len(EDGES)):
        rows = rows.join(classes, "class", "left_semi").withColumn("class", F.xxhash64("class", f"b{k}")).drop(f"b{k}")
        rows = written(rows, "refined") if k + 1 < len(EDGES) else rows
        classes = _several(rows)
    return classes


def first_ids(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(class, first_id) of classes with one text, and (class, text, first_id) of those with several, if there are any.

    docs: doc_id, text, class.
    """
    few = classes.count() <= BROADCAST_CLASSES
    members = docs.join(F.broadcast(classes) if few else classes, "class", "left_semi")
    texts = members.groupBy("class", "text").agg(F.min("doc_id").alias("first_id"))
    found = written(texts.groupBy("class").agg(F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("n_texts")), "first_ids")
    mixed = found.where("n_texts > 1").select("class")
    alone = found.where("n_texts = 1").select("class", "first_id")
    if mixed.isEmpty():
        return alone, None
    return alone, written(docs.join(mixed, "class", "left_semi").groupBy("class", "text").agg(F.min("doc_id").alias("first_id")), "texts_of_mixed_classes")


def mark_copies(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with a column `copy`: whether the text stands under a smaller doc_id too.

    docs: doc_id, text, rows's other columns; rows: what of docs is narrow, with length, block hashes b0, b1, ... and class.
    """
    hashes = [f"b{k}" for k in range(len(EDGES))]
    alone, mixed = first_ids(docs.select("doc_id", "text", class_of(F.col("text")).alias("class")), refined_classes(rows))
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("copy")
    kept = [c for c in rows.columns if c not in ("class", "length", *hashes)]
    if mixed is None:
        return rows.join(alone, "class", "left").select(*kept, later)
    of_mixed = docs.select(*kept, "text", class_of(F.col("text")).alias("class")).join(mixed, ["class", "text"]).select(*kept, later)
    return rows.join(mixed.select("class").distinct(), "class", "left_anti").join(alone, "class", "left").select(*kept, later).unionByName(of_mixed)


def failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A few words, B repeated words, C capitals, D symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    flagged = slim.select("doc_id", "part", failures(text).alias("mask"), F.char_length(text).cast("long").alias("length"), class_of(text).alias("class"), *(block_hash(text, k).alias(f"b{k}") for k in range(len(EDGES))))
    rows = written(flagged, "filter_flags")
    with_mask = slim.withColumn("mask", failures(text))
    marked = mark_copies(rows, with_mask)
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = written(known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "marks")
    bit = F.when(F.col("copy"), 1 << LETTERS.index("E")).otherwise(0)
    return marked.join(known, "doc_id", "left").select("part", (F.col("mask") + bit).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(masked: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, good, toxic) of each document; bit i is filter letters[i]."""
    counts = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters)))).alias("filter_order")
    has = {x: F.col("mask").bitwiseAND(1 << i) != 0 for i, x in enumerate(letters)}
    # The step at which a mask's documents go, one past the last if they stay.
    gone = F.least(*(F.when(h, F.instr("filter_order", x)).otherwise(len(letters) + 1) for x, h in has.items()), F.lit(len(letters) + 1))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    rows = counts.select("*", orders).select("*", gone.alias("gone"), steps).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    rows = rows.withColumn("bit", F.element_at(F.create_map(*(F.lit(v) for i, x in enumerate(letters) for v in (x, 1 << i))), F.col("letter")))
    fails, here = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("gone") == F.col("step")
    count = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))
    summed = rows.groupBy("part", "filter_order", "step", "letter").agg(
        count("n", F.col("gone") > F.col("step")).alias("kept"),
        count("n", here).alias("removed"),
        count("n", fails & (F.col("gone") < F.col("step"))).alias("redundant"),
        count("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        count("good", here).alias("good_lost"),
        count("toxic", here).alias("toxic_lost"),
    )
    return summed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over docs(doc_id, text, lang) with labels(doc_id, quality, toxic)."""
    return audit(masks(docs, labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
first_of AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
w AS (SELECT d.doc_id, part, t, first_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d JOIN first_of USING (t)),
good AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic,
  CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN good g ON g.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE length(list_aggregate(list_distinct([a.x, b.x, c.x, d.x, e.x]), 'string_agg', '')) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS fails_here, fails = x AS alone,
  length(translate(fails, before, '')) < length(fails) AS gone_before FROM c, s),
g AS (SELECT part, filter_order, step, x,
  sum(CASE WHEN NOT gone_before AND NOT fails_here THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN NOT gone_before AND fails_here THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN gone_before AND fails_here THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone_before AND fails_here THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN NOT gone_before AND fails_here THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g
"""
