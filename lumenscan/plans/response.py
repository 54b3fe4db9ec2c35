"""Responses within a budget: what is worst comes first, and whole entries are left out rather than cut."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import re
from collections.abc import Sequence
from typing import Any

# Tokens of a tool's response.
BUDGETS = {"profile": 1500, "find_issues": 1200, "explore_schema": 1000, "load_dataset": 800, "check_relationships": 800, "analyze_target": 800, "analyze_column": 600, "query": 500, "clean_data": 500, "history": 500, "connect_database": 500}
RETRYABLE = frozenset(("CONNECTION_FAILED", "QUERY_TIMEOUT"))
CLIP = 60


def tokens(value: Any) -> int:
    return math.ceil(len(json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)) / 4)


def significant(x: float, digits: int = 3) -> float | int | None:
    if isinstance(x, bool) or isinstance(x, int):
        return x
    if not math.isfinite(x):
        return None
    y = float(f"{x:.{digits}g}")
    return int(y) if y == int(y) and abs(y) < 1e15 else y


def to_json(value: Any, digits: int = 3) -> Any:
    """Plain JSON: unknown numbers are null, dates ISO, long texts clipped; exact digits under ``rows`` and ``result``."""
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return significant(float(value), digits)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): to_json(v, 12 if k in ("rows", "result") else digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json(v, digits) for v in value]
    text = str(value)
    return text if len(text) <= CLIP else text[: CLIP - 1] + "…"


def compact(value: Any) -> Any:
    """Without empty texts, lists and objects and without nulls of objects; zeros, false and nulls of lists stay."""
    if isinstance(value, dict):
        found = {k: compact(v) for k, v in value.items()}
        return {k: v for k, v in found.items() if v is not None and v != "" and v != [] and v != {}}
    return [compact(v) for v in value] if isinstance(value, list) else value


def fit(entries: Sequence[Any], budget: int) -> tuple[list[Any], int]:
    """The first entries that fit, one at least, and how many were left out."""
    kept, used = [], 0
    for e in entries:
        cost = tokens(e)
        if kept and used + cost > budget:
            break
        kept.append(e)
        used += cost
    return kept, len(entries) - len(kept)


def envelope(tool: str, body: dict, findings: Sequence[Any] = ()) -> dict:
    budget = BUDGETS.get(tool, 500)
    shown, left = fit([compact(to_json(f)) for f in findings], max(100, budget - tokens(to_json(body))))
    note = f"{left} more findings were left out" if left else None
    return compact({"ok": True, "tool": tool, **to_json(body), "findings": shown, "note": note})


def error(code: str, message: str, remedy: str | None = None) -> dict:
    return compact({"ok": False, "error": {"code": code, "message": redact(message), "retryable": code in RETRYABLE, "remedy": remedy}})


def redact(text: str) -> str:
    """Without passwords of addresses and keyword arguments."""
    text = re.sub(r"(\w+://[^:/@\s]+):[^@\s]*@", r"\1:***@", text)
    return re.sub(r"(?i)\b(password|passwd|pwd|secret|token)\s*[=:]\s*\S+", r"\1=***", text)
