"""Tokens and evidence of award texts, in Python over batches of texts: what a phrase gives is worked out once, not for each text that has it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

from verdigris.functions import legal_tables as t
from verdigris.functions.fragments import KEPT, compiled, has

_STOP = frozenset(t.STOP_WORDS)
_TERMS = [(x, t.SYNONYMS.get(x, x)) for x in t.LEGAL_TERMS]
EVIDENCE = "case_id long, name string, provider string, matched string, confidence double"


@lru_cache(KEPT)
def tokens(run: str) -> tuple[str, ...]:
    """Tokens of a run of letters and digits: terms of the law first, each taken out in turn; then short segments whole and longer ones as windows of two and three characters; stop words go and synonyms are merged.

    No term has another character than these, so a text's runs have its tokens.
    """
    out = []
    for term, token in _TERMS:
        if term in run:
            out += [token] * run.count(term)
            run = run.replace(term, " ")
    for seg in run.split(" "):
        n = len(seg)
        if n >= 2:
            grams = [seg] if n <= 4 else [seg[i : i + 2] for i in range(n - 1)] + [seg[i : i + 3] for i in range(n - 2)]
            out += [t.SYNONYMS.get(g, g) for g in grams if g not in _STOP]
    return tuple(out)


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of batches of texts: runs are counted before they are cut."""
    other = compiled("[^一-龥a-zA-Z0-9]+")
    for batch in batches:
        runs: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            if text is not None:
                runs.update(other.split(text))
        counts: dict[str, int] = {}
        for run, n in runs.items():
            if len(run) >= 2:
                for token in tokens(run):
                    counts[token] = counts.get(token, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["token", "n"])


@lru_cache(KEPT)
def _provider(sentence: str) -> str | None:
    """Who hands something in by a sentence: the actor before the first verb, unless that is denied; None without a verb."""
    verb = compiled(t.HANDED_IN).search(sentence)
    if not verb:
        return None
    before = sentence[: verb.start()]
    if has(before, "(未|没|没有|未能)$"):
        return "unknown"
    if has(before, "第三方|第三人"):
        return "third_party"
    return "court" if has(before, "(本院|法院)(依法)?$") else "employer" if "被申请人" in before else "employee" if "申请人" in before else "unknown"


def _clause_with(text: str, pattern: str) -> str | None:
    """The first clause that has the pattern."""
    m = compiled(pattern).search(text)
    if not m:
        return None
    start = max(text.rfind(mark, 0, m.start()) for mark in "，。；\n") + 1
    end = compiled("[，。；\\n]").search(text, m.end())
    return text[start : end.start() if end else len(text)].strip(" ")


def evidence(text: str) -> list[tuple[str, str, str, float]]:
    """(name, provider, matched, confidence) of each kind of evidence that a text names."""
    handed = None
    out = []
    for name, words, part in t.EVIDENCE_KINDS:
        if not any(w in text for w in words):
            continue
        if handed is None:
            handed = [(s, who) for s in (s.strip(" ") for s in compiled("[。；\\n]").split(text)) if (who := _provider(s))]
        sentence, provider = next(((s, who) for s, who in handed if any(w in s for w in words)), (None, "unknown"))
        if provider != "unknown":
            out.append((name, provider, sentence, 0.9))
        else:
            clause = _clause_with(text, part)
            out.append((name, provider, clause or words[0], 0.7 if clause else 0.5))
    return out


def all_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``EVIDENCE`` of batches of (case_id, text)."""
    for batch in batches:
        rows = [(case, *x) for case, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for x in evidence(text)]
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["case_id", "name", "provider", "matched", "confidence"])
