"""Line deduplication across documents.

Normalised lines are hashed and exploded, the distinct documents of each hash
are counted, and the lines of hashes found in many documents are dropped; what
is left is reassembled by position.

Texts are split and hashed once, into a table of positions and hashes that both
the count and the search for dropped positions read.  Only hashes are shuffled
for counting: a row for each line of a document, spread by line and document
before documents are counted, so that a line which a third of all documents
share lies in no single task.  The join that finds a document's dropped
positions moves hashes and positions, never text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import SPACES, materialise, with_row_key


def line_hashes(texts: pa.Array) -> pa.Array:
    """For each text the positions of its lines that have a key, and 128 bits of each key, so that no two of 10^12 meet by chance.

    The key is the line without white space at both ends, A-Z lower-cased, which
    is what bytes.strip and bytes.lower do.
    """
    ends, pos, digests = [0], [], []
    for text in texts.cast(pa.binary()).to_pylist():
        for p, line in enumerate(text.lower().split(b"\n")):
            if key := line.strip():
                pos.append(p)
                digests.append(xxhash.xxh3_128_digest(key))
        ends.append(len(pos))
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
    lines = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), *(pa.array(np.ascontiguousarray(x)) for x in halves)], names=["pos", "a", "b"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)


def _hashed(rows: DataFrame) -> DataFrame:
    """row_key and lines (position and hash of each key) of rows with row_key and text, as a table."""
    lines = F.arrow_udf(line_hashes, "array<struct<pos:int,a:long,b:long>>")
    return materialise(rows.select("row_key", lines(F.col("text")).alias("lines")))


def frequent_lines(hashed: DataFrame, min_docs: int, by_text: bool = False) -> DataFrame:
    """a, b: hashes of the line keys found in at least min_docs documents; hashed has row_key and lines.

    A key counts once per document, and repeated rows are one document; so are
    all rows of the same text with ``by_text``.
    """
    doc = F.col("row_key.h" if by_text else "row_key")
    found = hashed.select(doc.alias("doc"), F.inline("lines"))
    return found.groupBy("a", "b").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= min_docs).select("a", "b")


def _kept(docs: DataFrame, id_col: str, text_col: str, min_docs: int, whole_rows: bool, by_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept; and the whole input row as a struct, if asked for."""
    more = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if whole_rows else []
    keyed = with_row_key(docs, id_col, text_col, *more)
    hashed = _hashed(with_row_key(docs, id_col, text_col))
    frequent = materialise(frequent_lines(hashed, min_docs, by_text))
    hits = hashed.select("row_key", F.inline("lines"))
    dropped = hits.join(frequent, ["a", "b"], "left_semi").groupBy("row_key").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    extra = ["row"] if whole_rows else []
    both = keyed.join(dropped, keyed["row_key"].eqNullSafe(dropped["row_key"]), "left").select("doc_id", "text", "drop", *extra)
    lines = F.split("text", "\n")
    drop = F.coalesce("drop", F.array().cast("array<int>"))
    # what is kept lies between successive dropped positions: slices, so the work is linear in the lines
    edges = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    gaps = F.transform(drop, lambda p, i: F.slice(lines, F.get(edges, i) + 2, p - F.get(edges, i) - 1))
    tail = F.slice(lines, F.get(edges, F.size(drop)) + 2, F.size(lines) - F.get(edges, F.size(drop)) - 1)
    kept = F.flatten(F.concat(gaps, F.array(tail)))
    return both.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(drop).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
        *extra,
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """Drop the lines whose key is found in at least ``min_docs`` documents.

    Returns one row per input row: doc_id, n_lines, n_dropped, kept (the other
    lines joined by \\n).  Extra columns are ignored, whatever their names.

    * A null or empty text is one empty line, which is never dropped.
    * Lines without a character after stripping are never dropped.
    * A key counts once per document, however often the document has it;
      repeated rows are one document, and each of them is returned.
    * An empty table gives an empty result.
    """
    return _kept(docs, id_col, text_col, min_docs, whole_rows=False)


def without_frequent_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, min_docs: int = 10, by_text: bool = False, keep_empty: bool = False) -> DataFrame:
    """The rows of docs with all their columns, their texts without the lines that dedup_lines drops.

    ``length_col`` gets the new text's length.  A row of whose text no word is
    left after dropping lines goes, or stays with what is left with
    ``keep_empty``; rows that lose no line stay as they are, null texts included.
    With ``by_text`` a key counts once per distinct text, so a group of exact
    copies is one document and doesn't make its own lines frequent.
    """
    out = _kept(docs, id_col, text_col, min_docs, whole_rows=True, by_text=by_text)
    if not keep_empty:
        out = out.where((F.col("n_dropped") == 0) | (F.btrim("kept", F.lit(SPACES)) != ""))
    changed = F.col("n_dropped") > 0
    new = {text_col: F.when(changed, F.col("kept"))} | ({length_col: F.when(changed, F.length("kept").cast(docs.schema[length_col].dataType))} if length_col else {})
    return out.select(*(F.when(changed, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
