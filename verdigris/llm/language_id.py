"""Language identification by compression.

A text belongs to the language whose zstandard raw-content dictionary makes it
smallest; where the second language is close, the text is rejected.  The
dictionaries come from hashed pieces of a bounded sample of labelled rows, cut
before they are collected; every text is classified whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import held_by_worker

#: Bytes of dictionary for each language, and labelled rows from which they are taken.
DICT_BYTES = 1 << 17
SAMPLE_ROWS = 600
#: Code points of a piece of a sampled text.
SAMPLE_PIECE = 256
#: A text is compressed in pieces of so many bytes, so that the dictionary and not the text's own past decides.
PIECE = 4096
LEVEL = 6
#: Bits by which a byte saved counts towards the score.
BITS_PER_BYTE = 0.5
#: A text is kept if the second language needs at least this share of the best one's bytes more,
#: and, which decides for short texts only, so many bytes.
MIN_MARGIN = 0.12
MIN_LEAD = 3
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    """Lower case, with one space for whatever isn't a letter: symbols, digits and case say little about language."""
    return _NO_LETTER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def _pieces(size: int, count: Column) -> Column:
    """Pieces of so many code points, one at a hashed place of each of ``count`` equal stretches of the text, in hashed order; a text that isn't longer is whole."""
    length = F.length("text")
    count = F.greatest(F.least(count, F.floor(length / size)), F.lit(1)).cast("int")
    width = F.floor(length / count).cast("int")

    def cut(i: Column) -> Column:
        h = F.xxhash64("h", i)
        at = i * width + F.pmod(h, F.greatest(width - size + 1, F.lit(1))).cast("int")
        return F.struct(h.alias("h"), F.substring(F.col("text"), at + 1, F.lit(size)).alias("piece"))

    return F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), count - 1), cut)), lambda x: x["piece"])


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES, sample_rows: int = SAMPLE_ROWS, sample_piece: int = SAMPLE_PIECE) -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows, most frequent language first.

    Of each language about ``sample_rows`` rows with the smallest hash of their
    id are read: a bounded sample that doesn't depend on the order of rows.  Only
    pieces of ``sample_piece`` code points from all over each text are collected,
    about four times the dictionary in all, as texts may be short.
    Rows without label or text are ignored; no labelled rows give no languages.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_rows / n))])
    place = (F.col("h") / F.lit(2.0**64)) + 0.5
    count = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, 4 * dict_bytes // (min(n, sample_rows) * sample_piece)))])
    cut = rows.select("lang", "h", "text", _pieces(sample_piece, count[F.col("lang")]).alias("pieces"))
    cut = cut.select("lang", "h", F.xxhash64("text").alias("t"), F.array_join("pieces", " ").alias("text"))
    sample = cut.where(place < share[F.col("lang")]).collect()
    out = {}
    for lang in sorted(counts, key=lambda k: (-counts[k], k)):
        texts = [normalise(r["text"]) for r in sorted((r for r in sample if r["lang"] == lang), key=lambda r: (r["h"], r["t"], r["text"]))]
        texts = texts or [normalise(r["text"]) for r in cut.where(F.col("lang") == lang).orderBy("h", "t", "text").limit(1).collect()]
        # even shares, so that no long document fills the dictionary
        share_bytes = max(256, dict_bytes // max(1, len(texts)))
        joined = b" ".join(t[:share_bytes] for t in texts)
        if len(joined) < dict_bytes:
            joined = b" ".join([*(t[share_bytes:] for t in texts), joined])
        out[lang] = joined[-dict_bytes:]
    return out


class Classifier:
    """Holds the digested dictionaries; made once for each Python worker."""

    def __init__(self, dicts: dict[str, bytes], piece: int = PIECE, level: int = LEVEL):
        self.langs, self.piece, self.compressors = list(dicts), piece, []
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
        for raw in dicts.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        self.plain = zstandard.ZstdCompressor(compression_params=params)

    def sizes(self, raw: bytes) -> list[int]:
        pieces = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)] or [b""]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, float, int]:
        # a number sign or fraction is no letter, although a word may hold it
        raw = normalise(text) if text and any(map(str.isalpha, text)) else b""
        if not raw or not self.langs:
            return UNKNOWN, 0.0, 0.0, 0
        sizes = self.sizes(raw)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))  # a tie: the more frequent language
        total = sum(2.0 ** (-min(BITS_PER_BYTE * (s - sizes[best]), 60)) for s in sizes)
        rest = [s for i, s in enumerate(sizes) if i != best]
        # a language alone is held against no dictionary at all
        second = min(rest) if rest else sum(len(self.plain.compress(raw[i : i + self.piece])) for i in range(0, len(raw), self.piece))
        lead = second - sizes[best]
        return self.langs[best], 1.0 / total, lead / max(sizes[best], 1), lead


def classify(dicts: dict[str, bytes], text: Column) -> Column:
    """A struct of lang, score (0 to 1), margin and lead (bytes saved against the second, as a share and as they are) for a text column."""

    @F.arrow_udf("lang string, score double, margin double, lead long")
    def run(texts: pa.Array) -> pa.Array:
        one = _classifier(dicts)
        out = [one(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64()))], ["lang", "score", "margin", "lead"])

    return run(text)


def _classifier(dicts: dict[str, bytes]) -> Classifier:
    return held_by_worker((Classifier, id(dicts)), lambda: Classifier(dicts), of=dicts)


def _sure(r: Column, min_margin: float, min_lead: int) -> Column:
    return (r["lang"] != UNKNOWN) & (r["margin"] >= min_margin) & (r["lead"] >= min_lead)


def identify(docs: DataFrame, dicts: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN, min_lead: int = MIN_LEAD) -> DataFrame:
    """One row per row: doc_id, lang_pred, score, margin, rejected.

    * Null or empty texts and texts without a letter are ``und`` with score 0, and rejected.
    * Equal sizes go to the language with more labelled rows.
    * A text whose margin is below ``min_margin``, or which leads by fewer than ``min_lead`` bytes, is rejected, but still gets its best language.
    * With one language, the second is compression without dictionary.
    * Without any language everything is ``und``.
    * Repeated rows are classified alike; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", classify(dicts, F.col("text")).alias("r"))
    return rows.select("doc_id", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), F.col("r.margin").alias("margin"), (~_sure(F.col("r"), min_margin, min_lead)).alias("rejected"))


def known_language(docs: DataFrame, dicts: dict[str, bytes], *, text_col: str = "text", min_margin: float = MIN_MARGIN, min_lead: int = MIN_LEAD) -> DataFrame:
    """The rows of docs, with all their columns, that identify doesn't reject."""
    return docs.where(_sure(classify(dicts, F.col(text_col)), min_margin, min_lead))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
