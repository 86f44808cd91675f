"""Grouping of spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of l letters is cut into two segments at the middle of its length.  One
edit leaves one of the two as it is, at its place or, behind a letter more, one
place later.  So every word is indexed by its two segments, and looked up with
its substrings at these places among words of its own length and of one letter
less; what meets is verified by edit distance.

A segment that many words share (an ending, say) would bring all of them
together.  Where more than ``HOT`` do, the other segment, which then holds the
edit, is cut evenly again and one of its halves has to agree as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import ascii_lower, materialise

#: Letters A to Z in either case and the code points U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of a segment from which on half of the other segment has to agree too.
HOT = 32


def words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", typo_rate: int | None = None, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: the runs of letters of all texts, A to Z in lower case, and how often each occurs.

    With ``typo_rate``, misspellings are planted: where it divides the crc32 of
    ``<id>:<run>``, the run loses the code point at that number modulo its length.

    * A null text has no words; a null id is written as nothing before the colon.
    * Words of fewer than ``min_length`` code points, after the loss, and those that occur fewer than ``min_count`` times are left out.
    * Repeated rows count each time; extra columns are ignored; an empty table gives an empty result.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(name.alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    run = F.col("run")
    runs = runs.where(F.length(run) >= min_length)
    # lower() is much faster, and the same for ASCII alone
    runs = runs.select("id", F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(ascii_lower(run)).alias("word"))
    if typo_rate:
        word = F.col("word")
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length(word)).cast("int")
        cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
        runs = runs.select(F.when(F.col("h") % typo_rate == 0, cut).otherwise(word).alias("word")).where(F.length("word") >= min_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _part(text: Column, at: Column, size: Column) -> Column:
    """size code points from at (from 0) on."""
    return F.substring(text, at + 1, size)


def _halves(rest: Column, length: Column, shift: Column) -> Column:
    """The two halves of the other segment of an indexed word of which ``length`` code points are in that segment, as found in ``rest``, which is longer by ``shift``."""
    cut = _half(length)
    return F.array(
        F.struct(F.lit(1).alias("half"), _part(rest, F.lit(0), cut).alias("more")),
        F.struct(F.lit(2).alias("half"), _part(rest, cut + shift, length - cut).alias("more")),
    )


def _segments(vocabulary: DataFrame, shift: int) -> DataFrame:
    """For words as they are indexed (shift 0) or looked up among words of ``shift`` code points less: word, n, length (of the indexed), side, seg, and halves of the rest."""
    w, by = F.col("word"), F.lit(shift)
    length = F.length(w) - shift
    cut = _half(length)
    head, tail = _part(w, F.lit(0), cut), _part(w, cut + by, length - cut)
    sides = F.array(
        F.struct(F.lit(1).alias("side"), head.alias("seg"), _halves(_part(w, cut, F.length(w)), length - cut, by).alias("halves")),
        F.struct(F.lit(2).alias("side"), tail.alias("seg"), _halves(_part(w, F.lit(0), cut + by), cut, by).alias("halves")),
    )
    return vocabulary.select("word", "n", length.alias("length"), F.explode(sides).alias("s")).select("word", "n", "length", "s.*")


def near_pairs(vocabulary: DataFrame, *, hot: int = HOT) -> DataFrame:
    """a, n_a, b, n_b: every two words of a table of distinct words (word, n) that differ by one inserted, deleted or replaced code point, once; b is the longer one or, of equal ones, the larger."""
    index, alike = _segments(vocabulary, 0), ["length", "side", "seg"]
    crowded = materialise(index.groupBy(*alike).agg(F.count("*").alias("crowd")).where(F.col("crowd") > hot).drop("crowd"))
    found = None
    for shift in (0, 1):
        probe = index if shift == 0 else _segments(vocabulary, 1).where(F.col("length") > 0)
        for many in (False, True):
            how, keys = ("left_semi", [*alike, "half", "more"]) if many else ("left_anti", alike)
            sides = []
            for side, names in ((index, ("a", "n_a")), (probe, ("b", "n_b"))):
                rows = side.join(crowded, alike, how)
                rows = rows.select(*alike, "word", "n", F.explode("halves").alias("x")).select(*alike, "word", "n", "x.*") if many else rows.drop("halves")
                sides.append(rows.withColumnsRenamed({"word": names[0], "n": names[1]}))
            met = sides[0].join(sides[1], keys)
            a, b = F.col("a"), F.col("b")
            cut = _half(F.col("length"))
            if shift == 0:
                met = met.where(a < b)
            else:  # where the letter more is at the middle, both segments agree: it counts on the first side
                met = met.where((F.col("side") == 1) | (_part(a, F.lit(0), cut) != _part(b, F.lit(0), cut)))
            if many:  # and likewise where it is at the middle of the other segment
                size = F.when(F.col("side") == 1, F.col("length") - cut).otherwise(cut)
                start = F.when(F.col("side") == 1, cut).otherwise(F.lit(0))
                met = met.where((F.col("half") == 1) | (_part(a, start, _half(size)) != _part(b, start, _half(size))))
            met = met.where(F.levenshtein(a, b, 1) == 1).select("a", "n_a", "b", "n_b")
            found = met if found is None else found.unionByName(met)
    return found


def variants(vocabulary: DataFrame, *, factor: int = 2, hot: int = HOT) -> DataFrame:
    """One row per word of a table of distinct words (word, n): word, form, root, n, n_near, form_n.

    * form: the near word of largest n (ties: the smallest in code-point order) if it occurs ``factor`` times as often at least, else null; form_n is its n.
    * root: where following forms from a word ends; the word itself if it has no form.
    * n_near: how many words are near.
    * A null word is left out; an empty table gives an empty result.
    """
    vocabulary = materialise(vocabulary.where(F.col("word").isNotNull()).select("word", "n"))
    pairs = materialise(near_pairs(vocabulary, hot=hot))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("near"))).alias("best"))
    rows = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    chosen = F.col("near_n") >= factor * F.col("n")
    rows = materialise(rows.select("word", F.when(chosen, F.col("near")).alias("form"), "n", "n_near", F.when(chosen, F.col("near_n")).alias("form_n")))
    roots = _roots(rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, root), which never come back, end.  Each round doubles the steps taken; forms grow at least twofold, so the rounds grow with the logarithm of a logarithm."""
    links = materialise(links)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(onward, "root", "left")
        links = materialise(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")
