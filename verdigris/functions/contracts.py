"""Contracts of JSON values: what is wrong with a value, and where."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ERRORS = 80
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float)}


def violations(value: object, contract: dict) -> list[tuple[str, str]]:
    """(path, code) of what breaks a contract, MOST_ERRORS at most, in the value's order; without recursion."""
    out: list[tuple[str, str]] = []
    todo: list[tuple[str, object, dict]] = [("", value, contract)]
    while todo and len(out) < MOST_ERRORS:
        path, v, rule = todo.pop()
        kind = rule.get("type")
        if v is None:
            out.append((path, "null_not_allowed"))
        elif "enum" in rule and v not in rule["enum"]:
            out.append((path, "invalid_enum"))
        elif kind and (not isinstance(v, _TYPES[kind]) or isinstance(v, bool) and kind in ("integer", "number")):
            out.append((path, "wrong_type"))
        elif kind == "array":
            todo.extend((f"{path}[{i}]", x, rule.get("items", {})) for i, x in reversed(list(enumerate(v))))
        elif kind == "object":
            known, at = rule.get("properties", {}), lambda k, path=path: f"{path}.{k}" if path else k
            out.extend((at(k), "missing_required_field") for k in rule.get("required", []) if k not in v)
            if rule.get("additionalProperties") is False:
                out.extend((at(k), "extra_field_rejected") for k in v if k not in known)
            todo.extend((at(k), v[k], known[k]) for k in reversed(known) if k in v)
    return out[:MOST_ERRORS]


def broken(value: Column, contract: dict) -> Column:
    """An array of (path, code) for JSON text; text that is no JSON breaks every contract at its root."""

    def one(text: str | None) -> list[dict]:
        try:
            found = violations(json.loads(text or ""), contract)
        except ValueError:
            found = [("", "not_json")]
        return [{"path": p, "code": c} for p, c in found]

    @F.arrow_udf("array<struct<path:string,code:string>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.list_(pa.struct([("path", pa.string()), ("code", pa.string())])))

    return run(value)
