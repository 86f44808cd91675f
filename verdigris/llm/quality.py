"""Quality rules with an n-gram perplexity model.

Base rules look at one text at a time.  The method's verdict comes from modified
Kneser-Ney models of characters, counted by Spark over all documents: the text's
log perplexity must lie within its language's band.  Characters are code points,
lower-cased, with one kind of digit and of space; nothing else is folded, so
texts of any script count, and the model grows with what the corpus has.

Each language has two models.  A text belongs to one of two folds by its hash and
is scored by the model of the other fold, so neither it nor a copy of it vouches
for itself; together the models count every text.

The models are kept as sorted arrays of n-gram hashes, cut by the character
before the predicted one into shards: all that predicts a character lies in one
shard, so a text's sum is the sum over shards.  Executors get at most
``MODEL_BYTES`` of shards at once; more of them are scored in further passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.shingles import WordHashes, mix, windows

ORDER = 5
#: Shards of a model, and bytes of shards that executors get at once.
SHARDS, MODEL_BYTES = 32, 128 << 20
#: Share of a character that the corpus lacks.
UNSEEN = 1.0 / (1 << 16)
#: Discounts are no less, so that what a context lacks always keeps a share.
LEAST_DISCOUNT = 0.01
#: Width of a band below and above the median: so many times the distance of the nearer quartile, as junk widens one side only.
LOW_WIDTH, HIGH_WIDTH = 10.0, 7.0
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
NO_LANG = "und"
#: Characters that a task counts at once, and n-grams that it holds.
CHUNK, HELD = 1_000_000, 2_000_000
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(ORDER)], np.uint64)
_PAD = np.full(ORDER - 1, 10, np.uint32)
_LETTERS: list[np.ndarray] = []
_HASHES = WordHashes()


def codes(text: str) -> np.ndarray:
    """The text's lower-cased code points; every digit is 0, white space but line ends a space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").copy()
    c[(c >= 48) & (c <= 57)] = 48
    c[(c == 9) | (c == 11) | (c == 12) | (c == 13) | (c == 160)] = 32
    return c


def letters(c: np.ndarray) -> int:
    """How many of the code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(k).isalpha() for k in range(0x32000)), bool, 0x32000))
    return int(_LETTERS[0][np.minimum(c, 0x31FFF)].sum())


def _hash(total: np.ndarray, n: int) -> np.ndarray:
    return mix(total * np.uint64(2) + np.uint64(n))


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with padding before each, and the places of their characters."""
    flat = np.concatenate([x for c in parts for x in (_PAD, c)])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.arange(sizes.sum()) + (ORDER - 1) * np.repeat(np.arange(1, len(parts) + 1), sizes)
    return flat.astype(np.uint64), at


def longest(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of ORDER characters that end at the places."""
    n = len(flat) - ORDER + 1
    total = np.zeros(n, np.uint64)
    for k in range(ORDER):
        total += flat[ORDER - 1 - k : ORDER - 1 - k + n] * _WEIGHTS[k]
    return _hash(total[at - ORDER + 1], ORDER)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, a place of each, how often each is found, and all places in the order of their hashes."""
    order = np.argsort(h)
    in_order = h[order]
    starts = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]]) if len(h) else np.zeros(0, np.int64)
    return in_order[starts], order[starts], np.diff(np.r_[starts, len(h)]), order


def hashes_at(flat: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the n-grams that end at the places, for n of 1 to ORDER, and of those that end before them, up to one less."""
    out: tuple[list, list] = ([], [])
    for shift, hashes in enumerate(out):
        total = np.zeros(len(at), np.uint64)
        for k in range(ORDER - shift):
            total = total + flat[at - shift - k] * _WEIGHTS[k]
            hashes.append(_hash(total, k + 1))
    return out


def _of_strings(grams: list[str], n: int) -> np.ndarray:
    """The hashes of n-grams of one length."""
    c = np.frombuffer("".join(grams).encode("utf-32-le", "replace"), dtype="<u4").reshape(-1, n).astype(np.uint64)
    return _hash((c * _WEIGHTS[:n][::-1]).sum(axis=1, dtype=np.uint64), n)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, fold, g, c: how often each n-gram is found in all texts of a language and fold.

    A task sums what its batches have before Spark sums the tasks'.
    """
    schema = pa.schema([("lang", pa.string()), ("fold", pa.int32()), ("g", pa.string()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        waiting: dict[tuple, list[np.ndarray]] = {}

        def count(model: tuple) -> None:
            flat, at = padded(waiting.pop(model))
            h, one, c, _ = distinct(longest(flat, at))
            known, grams, old = sums.get(model, (np.zeros(0, np.uint64), np.zeros(0, object), np.zeros(0, np.int64)))
            place, hit = _find(known, h)
            old = old.copy()
            old[place[hit]] += c[hit]
            fresh = np.flatnonzero(~hit)
            if len(fresh):  # their characters, from a place of each
                whole = flat.astype("<u4").tobytes().decode("utf-32-le")
                more = np.empty(len(fresh), object)
                more[:] = [whole[i - ORDER + 1 : i + 1] for i in at[one[fresh]].tolist()]
                known, grams, old = np.r_[known, h[fresh]], np.r_[grams, more], np.r_[old, c[fresh]]
                order = np.argsort(known)
                known, grams, old = known[order], grams[order], old[order]
            sums[model] = (known, grams, old)

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, fold), (_, grams, c) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([fold] * len(c), pa.int32()), pa.array(grams, pa.string()), pa.array(c, pa.int64())], schema=schema)
            sums.clear()

        size: dict[tuple, int] = {}
        for batch in batches:
            for lang, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                model, c = (lang, fold), codes(text.as_py())
                waiting.setdefault(model, []).append(c)
                size[model] = size.get(model, 0) + len(c)
                if size[model] >= CHUNK:
                    count(model)
                    size[model] = 0
            if sum(len(x[0]) for x in sums.values()) > HELD:
                yield from emit()
        for model in list(waiting):
            count(model)
        yield from emit()

    return docs.select("lang", "fold", "text").mapInArrow(run, "lang string, fold int, g string, c long").groupBy("lang", "fold", "g").agg(F.sum("c").alias("c"))


def estimate(counts: DataFrame, materialise) -> DataFrame:
    """Modified Kneser-Ney from counts of the longest n-grams: lang, fold, g (of 1 to ORDER characters), logp, logb (weight of the order above its context; 0 if it is none)."""
    model = ["lang", "fold"]
    orders = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # lower orders count the distinct characters that go before
        orders[n] = materialise(orders[n + 1].groupBy(*model, F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")))
    lower, out = None, None
    weights: dict[int, DataFrame] = {}
    for n in range(1, ORDER + 1):
        t = orders[n]
        n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
        ratio = F.coalesce(F.try_divide(n1, n1 + 2 * n2), F.lit(0.0))
        discount = lambda k, a, b: F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(k)), F.coalesce(k - (k + 1) * ratio * F.try_divide(b, a), F.lit(k / 2))))
        by_model = t.groupBy(*model).agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        by_model = by_model.select(*model, discount(1, n1, n2).alias("d1"), discount(2, n2, n3).alias("d2"), discount(3, n3, n4).alias("d3"))
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(F.broadcast(by_model), model).select(*model, "g", "c", d.alias("d"), F.substring("g", 1, n - 1).alias("ctx"))  # two rows for each language
        context = Window.partitionBy(*model, "ctx")  # as many rows as there are characters at most
        total = F.sum("c").over(context)
        t = t.select(*model, "g", "ctx", ((F.col("c") - F.col("d")) / total).alias("alpha"), (F.sum("d").over(context) / total).alias("gamma"))
        if n > 1:
            below = lower.select(*model, F.col("g").alias("tail"), F.col("p").alias("q"))
            t = t.withColumn("tail", F.substring("g", 2, n - 1)).join(below, [*model, "tail"]).select(*model, "g", "ctx", "gamma", (F.col("alpha") + F.col("gamma") * F.col("q")).alias("p"))
        else:
            t = t.select(*model, "g", "ctx", "gamma", (F.col("alpha") + F.col("gamma") * UNSEEN).alias("p"))
        lower = materialise(t)
        if n > 1:
            weights[n - 1] = lower.groupBy(*model, F.col("ctx").alias("g")).agg(F.first("gamma").alias("b"))
        orders[n] = lower
    for n in range(1, ORDER + 1):
        rows = orders[n].select(*model, "g", F.log("p").alias("logp"))
        if n < ORDER:  # a context may end no other n-gram of its length
            rows = rows.join(weights[n], [*model, "g"], "full").withColumn("logb", F.coalesce(F.log("b"), F.lit(0.0))).drop("b")
        else:
            rows = rows.withColumn("logb", F.lit(0.0))
        out = rows if out is None else out.unionByName(rows)
    return out


def packed(model: DataFrame) -> DataFrame:
    """lang, fold, shard, n (entries), and the shard's arrays: keys and logp of n-grams, bkeys and logb of contexts, each sorted by key.

    An n-gram lies in the shard of its last character but one, a context in that of its last; single characters lie in all.
    """
    cut = lambda at: F.pmod(F.ascii(F.substring("g", at, 1)), F.lit(SHARDS))
    size = F.length("g")
    probabilities = model.where(F.col("logp").isNotNull()).select("lang", "fold", "g", F.col("logp").alias("x"), F.lit(True).alias("is_p"), F.explode(F.when(size == 1, F.sequence(F.lit(0), F.lit(SHARDS - 1))).otherwise(F.array(cut(-2)))).alias("shard"))
    contexts = model.where((size < ORDER) & (F.col("logb") != 0)).select("lang", "fold", "g", F.col("logb").alias("x"), F.lit(False).alias("is_p"), cut(-1).alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        columns = []
        for wanted in (True, False):
            part = table.filter(table["is_p"] if wanted else pc.invert(table["is_p"]))
            grams, values = part["g"].to_pylist(), part["x"].to_numpy().astype(np.float32)
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            h = np.zeros(len(grams), np.uint64)
            for n in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == n)
                h[mine] = _of_strings([grams[i] for i in mine.tolist()], n)
            order = np.argsort(h)
            columns += [h[order].tobytes(), values[order].tobytes()]
        first = table.slice(0, 1)
        return pa.table([first["lang"], first["fold"], first["shard"], pa.array([table.num_rows], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], names=["lang", "fold", "shard", "n", "keys", "logp", "bkeys", "logb"])

    return probabilities.unionByName(contexts).groupBy("lang", "fold", "shard").applyInArrow(run, "lang string, fold int, shard int, n long, keys binary, logp binary, bkeys binary, logb binary")


class Model:
    """Sorted arrays of some shards of a model."""

    def __init__(self, shards: list[tuple]):
        """shards: (number, keys, logp, bkeys, logb), the arrays as bytes."""
        self.shards = np.zeros(SHARDS, bool)
        self.shards[[s[0] for s in shards]] = True
        self.keys, self.logp = self._merged([np.frombuffer(s[1], np.uint64) for s in shards], [np.frombuffer(s[2], np.float32) for s in shards])
        self.bkeys, self.logb = self._merged([np.frombuffer(s[3], np.uint64) for s in shards], [np.frombuffer(s[4], np.float32) for s in shards])

    @staticmethod
    def _merged(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        all_keys, first = np.unique(np.concatenate(keys), return_index=True)
        return all_keys, np.concatenate(values)[first]

    def log_p(self, h: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of n-grams from their hashes by order and their contexts'; what the model lacks is backed off."""
        count = len(h[0])
        out, weight, left = np.zeros(count), np.zeros(count), np.arange(count)
        for n in range(ORDER, 0, -1):
            at, hit = _find(self.keys, h[n - 1][left])
            out[left[hit]] = weight[left[hit]] + self.logp[at[hit]]
            left = left[~hit]
            if n > 1 and len(left):
                at, hit = _find(self.bkeys, contexts[n - 2][left])
                weight[left[hit]] += self.logb[at[hit]]
        out[left] = weight[left] + np.log(UNSEEN)
        return out

    def losses(self, parts: list[np.ndarray]) -> np.ndarray:
        """Nats of the characters of each text that the shards predict.

        The n-grams of all texts together are looked up once each.
        """
        flat, at = padded(parts)
        if not len(at):
            return np.zeros(len(parts))
        _, first, count, order = distinct(longest(flat, at))
        one = at[first]
        mine = self.shards[(flat[one - 1] % np.uint64(SHARDS)).astype(np.int64)]
        log_p = np.zeros(len(one))
        log_p[mine] = self.log_p(*hashes_at(flat, one[mine]))
        doc = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        return -np.bincount(doc[order], weights=np.repeat(log_p, count), minlength=len(parts))


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def _score(models: dict[tuple, Model], lang: Column, fold: Column, text: Column) -> Column:
    """A struct of loss (null without a model or a letter) and letters.

    All characters are predicted but only letters share the sum: marks in odd
    places, each cheap in a long run of them, then weigh on the words.
    """

    @F.arrow_udf("loss double, letters long")
    def run(langs: pa.Array, folds: pa.Array, texts: pa.Array) -> pa.Array:
        out: list = [None] * len(texts)
        size = [0] * len(texts)
        waiting: dict[tuple, list[tuple[int, np.ndarray]]] = {}
        held: dict[tuple, int] = {}

        def flush(model: tuple) -> None:
            rows = waiting.pop(model)
            for (i, _), x in zip(rows, models[model].losses([c for _, c in rows]).tolist(), strict=True):
                out[i] = x

        for i, (k, f, t) in enumerate(zip(langs.to_pylist(), folds.to_pylist(), texts, strict=True)):
            c, model = codes(t.as_py()), (k, 1 - f)
            size[i] = letters(c)
            if size[i] and model in models:
                waiting.setdefault(model, []).append((i, c))
                held[model] = held.get(model, 0) + len(c)
                if held[model] >= CHUNK:
                    flush(model)
                    held[model] = 0
        for model in list(waiting):
            flush(model)
        return pa.StructArray.from_arrays([pa.array(out, pa.float64()), pa.array(size, pa.int64())], names=["loss", "letters"])

    return run(lang, fold, text)


def passes(arrays: DataFrame) -> list[list[tuple]]:
    """The shards (lang, fold, shard) of each pass; only their names and sizes come to the driver."""
    rows = arrays.select("lang", "fold", "shard", (12 * F.col("n")).alias("size")).collect()  # SHARDS rows for each model
    out, held = [[]], 0
    for r in sorted(rows):
        if out[-1] and held + r["size"] > MODEL_BYTES:
            out, held = [*out, []], 0
        out[-1].append(tuple(r)[:3])
        held += r["size"]
    return out


def log_perplexity(docs: DataFrame, arrays: DataFrame, more: list[Column], materialise) -> DataFrame:
    """docs (lang, fold, text and others) without text, with ``more`` columns, letters and log_ppl (nats a letter; null without a letter or a model).

    With several passes, the sums of each distinct text are added up and joined back by its hash.
    """
    columns = [c for c in docs.columns if c != "text"]
    ppl = F.when(F.col("letters") > 0, F.col("loss") / F.col("letters")).alias("log_ppl")
    groups, parts = passes(arrays), []
    ident = [F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("i")]
    for group in groups:
        wanted = docs.sparkSession.createDataFrame(group, "lang string, fold int, shard int") if group else None
        got = arrays.join(F.broadcast(wanted), ["lang", "fold", "shard"], "left_semi").toArrow() if group else None
        shards: dict[tuple, list[tuple]] = {}
        for k in range(got.num_rows if got else 0):
            shards.setdefault((got["lang"][k].as_py(), got["fold"][k].as_py()), []).append((got["shard"][k].as_py(), *(got[c][k].as_buffer() for c in ("keys", "logp", "bkeys", "logb"))))
        models = {model: Model(held) for model, held in shards.items()}
        scored = _score(models, F.col("lang"), F.col("fold"), F.col("text")).alias("x")
        if len(groups) == 1:
            return docs.select(*columns, *more, scored).select("*", "x.*").withColumn("log_ppl", ppl).drop("x", "loss")
        parts.append(materialise(docs.select("lang", *ident, scored).select("lang", "h", "i", "x.*").dropDuplicates(["lang", "h", "i"])))
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    sums = materialise(sums.groupBy("lang", "h", "i").agg(F.sum("loss").alias("loss"), F.max("letters").alias("letters")).select("lang", "h", "i", "letters", ppl))
    return materialise(docs.select(*columns, *more, *ident)).join(sums, ["lang", "h", "i"]).drop("h", "i")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of width words that are found twice or more in the text; all occurrences count."""
    h = windows(_HASHES.of(words), width)
    if len(h) < 2:
        return 0
    in_order = np.sort(h)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base(text: Column) -> Column:
    @F.arrow_udf(", ".join(f"{c} long" for c in _BASE))
    def run(texts: pa.Array) -> pa.Array:
        rows = [base_counts(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_BASE))], names=list(_BASE))

    return run(text)


def bands(scored: DataFrame, low: float = LOW_WIDTH, high: float = HIGH_WIDTH) -> DataFrame:
    """lang, ppl_low, ppl_high: a band about the language's median log perplexity; a row for each language."""
    q = F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000)
    out = scored.groupBy("lang").agg(q.alias("q"))
    at = lambda i: F.get("q", F.lit(i))
    spread = F.least(at(1) - at(0), at(2) - at(1))
    return out.select("lang", (at(1) - low * spread).alias("ppl_low"), (at(1) + high * spread).alias("ppl_high"))


def assess(docs: DataFrame, *, materialise, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: doc_id, the base counts, base_failed, log_ppl, ppl_low, ppl_high, kept.

    ``materialise`` writes an intermediate frame and reads it again.

    * A null text is empty: no words, base_failed, not kept, log_ppl null.
    * A text without a letter is not kept.
    * A null language is a language of its own.  A language all of whose texts are in one fold has no model for them: log_ppl is null, and the base rules decide.
    * A text on the edge of its band is kept.
    * Repeated rows are counted and assessed one by one; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(2)), F.lit(2)).cast("int"))
    arrays = materialise(packed(estimate(materialise(count_grams(rows)), materialise)))
    scored = log_perplexity(rows, arrays, [base(F.col("text")).alias("b")], materialise)
    scored = materialise(scored.select("doc_id", "lang", "letters", "log_ppl", "b.*"))
    out = scored.join(F.broadcast(bands(scored)), "lang", "left")  # a row for each language
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    fits = (F.col("letters") > 0) & F.coalesce(F.col("log_ppl").between(F.col("ppl_low"), F.col("ppl_high")), F.lit(True))
    return out.select("doc_id", *_BASE, "base_failed", "log_ppl", "ppl_low", "ppl_high", (~F.col("base_failed") & fits).alias("kept"))
