"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if the document has at least ``percent`` of
the item's distinct word shingles.  The search is native: DataFrame functions only.

1. Items fall into partitions by the number of their shingles (powers of two).
   An item of n shingles of which ``need`` must be found keeps a bottom-k MinHash
   sketch: its n - need + 1 smallest shingle hashes.  A document that contains
   the item has at least one of them, so the search loses nothing.
2. A partition's largest sketch value bounds what matters of a document: only
   shingles with hashes up to that, about a quarter, are looked up.  A document
   is held against the partitions whose items it is long enough to contain.
3. The documents with a hit are read again, and their shingles are joined with
   the items' shingles as strings; the counts of that join are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import SPACES, ascii_lower, materialise, with_row_key

SIZE = 5
PERCENT = 80


def words(text: Column) -> Column:
    """Words at ASCII white space, A-Z lower-cased; none in an empty text."""
    trimmed = F.btrim(ascii_lower(text), F.lit(SPACES))
    return F.when(trimmed != "", F.split(trimmed, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))


def _places(width: Column | str) -> Column:
    """1-based starts of the windows of so many words; null (no rows when exploded) if there are none."""
    return F.expr(f"CASE WHEN size(words) >= {width} AND {width} > 0 THEN sequence(1, size(words) - {width} + 1) END")


def _shingles(rows: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """A row for each window of each width: the keep columns, width, at and words."""
    many = rows.withColumn("width", F.explode(F.array(*map(F.lit, widths))) if len(widths) > 1 else F.lit(widths[0]))
    return many.select(*keep, "words", "width", F.explode(_places("width")).alias("at"))


def _window() -> Column:
    return F.slice("words", F.col("at"), F.col("width"))


def _text_of_window() -> Column:
    return F.array_join(_window(), " ")


def item_shingles(items: DataFrame, *, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """item_key, item_id, width, n, need, s, h: a row for each distinct shingle of each item."""
    rows = with_row_key(items, id_col, text_col).select(F.col("doc_id").alias("item_id"), F.col("row_key").alias("item_key"), words(F.col("text")).alias("words")).dropDuplicates(["item_key"])
    rows = rows.withColumn("width", F.least(F.lit(size), F.size("words")))
    each = rows.select("item_id", "item_key", "words", "width", F.explode(_places("width")).alias("at")).select("item_id", "item_key", "width", _text_of_window().alias("s"), F.xxhash64(_window()).alias("h")).distinct()
    counts = each.groupBy("item_key").agg(F.count("*").alias("n"))
    return each.join(counts, "item_key").withColumn("need", F.floor((F.col("n") * percent + 99) / 100).cast("long"))


def sketches(shingles: DataFrame) -> DataFrame:
    """width, h, part, need: the smallest n - need + 1 hashes of each item, with the item's size partition."""
    smallest = F.slice(F.array_sort(F.collect_set("h")), 1, F.any_value("n") - F.any_value("need") + 1)
    one = shingles.groupBy("item_key").agg(smallest.alias("sketch"), *(F.any_value(c).alias(c) for c in ("width", "n", "need")))
    return one.select("width", F.floor(F.log2("n")).cast("int").alias("part"), "need", F.explode("sketch").alias("h"))


def _bound(parts: list) -> Column:
    """The largest sketch value among the partitions whose items fit into a document with so many words; null if none does."""
    out, largest = F.lit(None).cast("long"), None
    steps = []
    for width, need, top in sorted((p["width"], p["least"], p["top"]) for p in parts):
        steps.append((need + width - 1, top))
    for least, top in sorted(steps):
        largest = top if largest is None else max(largest, top)
        out = F.when(F.size("words") >= least, F.lit(largest)).otherwise(out)
    return out


def _contained(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, size: int, percent: int) -> DataFrame:
    """row_key, item_id, n_item, n_shared of all contained items."""
    shingles = materialise(item_shingles(items, id_col=item_id_col, text_col=item_text_col, size=size, percent=percent))
    sketch = materialise(sketches(shingles))
    # a row for each size partition and width: at most 64 times the number of words in a shingle
    parts = sketch.groupBy("width", "part").agg(F.min("need").alias("least"), F.max("h").alias("top")).collect()
    widths = sorted({p["width"] for p in parts}) or [size]
    rows = with_row_key(docs, id_col, text_col)
    sketch = sketch.select("width", "h").distinct()

    probed = rows.select("row_key", words(F.col("text")).alias("words")).withColumn("bound", _bound(parts)).where("bound IS NOT NULL")
    small = _shingles(probed, widths, "row_key", "bound").select("row_key", "bound", "width", F.xxhash64(_window()).alias("h")).where("h <= bound")
    hits = small.select("row_key", "width", "h").join(sketch, ["width", "h"], "left_semi").select("row_key").distinct()
    hits = materialise(hits)

    likely = rows.join(hits, rows["row_key"].eqNullSafe(hits["row_key"]), "left_semi").select("row_key", words(F.col("text")).alias("words"))
    own = _shingles(likely, widths, "row_key").select("row_key", "width", _text_of_window().alias("s"))
    shared = own.join(shingles, ["width", "s"]).select("row_key", "item_key", "item_id", "n", "need", "s").distinct()
    found = shared.groupBy("row_key", "item_key").agg(F.count("*").alias("n_shared"), F.any_value("item_id").alias("item_id"), F.any_value("n").alias("n_item"), F.any_value("need").alias("need"))
    return found.where("n_shared >= need").select("row_key", "item_id", "n_item", "n_shared")


def contained_items(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, n_item, n_shared, containment (n_shared / n_item).

    Shingles are ``size`` words, A-Z lower-cased, compared as sets.

    * An item with fewer words is one shingle of all its words; an item without words is contained nowhere.
    * Null texts are empty.  Null ids are ids like any other.
    * Repeated rows give one result; rows with one id and different texts, of
      documents or items, are held against each other separately, so such an id
      can come more than once.
    * Extra columns are ignored; empty tables give an empty result.
    """
    found = _contained(docs, items, id_col, text_col, item_id_col, item_text_col, size, percent)
    return found.select(F.col("row_key.doc_id").alias("doc_id"), "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """The rows of docs, with all their columns, that contain none of the items; what counts as contained is as in contained_items."""
    found = _contained(docs, items, id_col, text_col, item_id_col, item_text_col, size, percent)
    gone = materialise(found.select(F.col("row_key.doc_id").alias("gone_id"), F.col("row_key.h").alias("gone_h")).distinct())
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["gone_h"])
    return docs.join(gone, same, "left_anti")
