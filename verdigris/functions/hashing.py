"""Canonical JSON, hash chains and the reproducible generator behind samples."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Samples must be the same wherever they are drawn.  The seed is
# hashed with the 32-bit finaliser of MurmurHash3, and numbers come from the
# public generator mulberry32.
_MASK = 0xFFFFFFFF


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks; keys whose value is None stay as null."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def row_fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as canonical JSON; they are put in order of name by the caller. Nulls are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def seed_state(seed: str) -> int:
    """A 32-bit state from a seed's UTF-16 units."""
    units = [int.from_bytes(seed.encode("utf-16-le", "surrogatepass")[i : i + 2], "little") for i in range(0, 2 * (len(seed.encode("utf-16-le", "surrogatepass")) // 2), 2)]
    h = 1779033703 ^ len(units)
    for u in units:
        h = (h ^ u) * 3432918353 & _MASK
        h = (h << 13 | h >> 19) & _MASK
    h = (h ^ h >> 16) * 2246822507 & _MASK
    h = (h ^ h >> 13) * 3266489909 & _MASK
    return h ^ h >> 16


class Generator:
    """Uniform numbers in [0, 1) from a 32-bit counter."""

    def __init__(self, seed: str):
        self.state = seed_state(seed)

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & _MASK
        t = self.state
        t = (t ^ t >> 15) * (t | 1) & _MASK
        t = (t ^ (t + ((t ^ t >> 7) * (t | 61) & _MASK))) & _MASK
        return ((t ^ t >> 14) & _MASK) / 4294967296


def shuffled(ids: list[str], seed: str) -> list[str]:
    """The ids, put in ascending order and then shuffled from the end."""
    out, draw = sorted(ids, key=lambda x: x.encode("utf-16-be", "surrogatepass")), Generator(seed)
    for i in range(len(out) - 1, 0, -1):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def stratum_seed(global_seed: str, stratum_key: str, algorithm: str) -> str:
    raw = json.dumps({"algorithmVersion": algorithm, "globalSeed": global_seed, "stratumKey": stratum_key}, separators=(",", ":"), ensure_ascii=False)
    return "stratum-seed-v1:" + sha256(raw)


def seed_of_stratum(global_seed: str, stratum: Column, algorithm: str) -> Column:
    """stratum_seed for a column of keys."""
    fields = F.to_json(F.struct(F.lit(algorithm).alias("algorithmVersion"), F.lit(global_seed).alias("globalSeed"), stratum.alias("stratumKey")))
    return F.concat(F.lit("stratum-seed-v1:"), F.sha2(fields, 256))
