"""Strict reading of model answers: one JSON object of just the expected fields, or an error."""

from __future__ import annotations

import json

FIELDS = ["packageName", "jdkVersion", "resource", "resourceFile", "hints", "reminders", "background"]


def _object(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated field")
    return dict(pairs)


def strict_object(text: str, fields: list[str]) -> dict:
    out = json.loads(text, object_pairs_hook=_object, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
    if not isinstance(out, dict) or not set(out) <= set(fields):
        raise ValueError("not one object of the expected fields")
    return out


def rerank_order(text: str, n: int) -> list[int]:
    """The order of {"order": [...]}: distinct places below n, possibly fewer or none."""
    order = strict_object(text, ["order"]).get("order")
    if not isinstance(order, list) or any(type(i) is not int or not 0 <= i < n for i in order) or len(set(order)) < len(order):
        raise ValueError("not an order")
    return order


def enrichment(text: str) -> dict:
    """Strings are trimmed, lists trimmed and without blanks; missing fields are empty."""
    raw = strict_object(text, FIELDS)
    out = {}
    for name in FIELDS:
        value = raw.get(name)
        if name in ("hints", "reminders", "background"):
            if value is not None and (not isinstance(value, list) or any(not isinstance(x, str) for x in value)):
                raise ValueError(name)
            out[name] = [x.strip() for x in value or [] if x.strip()]
        else:
            if value is not None and not isinstance(value, str):
                raise ValueError(name)
            out[name] = (value or "").strip()
    return out
