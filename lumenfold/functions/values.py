"""Values at the engine's edge: JSON forms of cells, canonical JSON, key names."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Mapping
from datetime import date
from decimal import Decimal

#: Words that no key of a recorded decision may hold.
FORBIDDEN_KEYS = ("gold", "expected", "score", "accuracy", "task_success", "hallucination", "significance", "latency", "cost")


def canonical(value) -> bytes:
    """JSON with sorted keys and no spaces, UTF-8; not-a-number and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def json_safe(value):
    """A cell for a tool's result: dates as ISO text, decimals as doubles, what is not a finite number as null."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value.isoformat() if isinstance(value, date) else value


def strict(value):
    """A cell for evidence: like ``json_safe``, but a value that JSON can't hold is an error, never a null."""
    if isinstance(value, (float, Decimal)) and not math.isfinite(value):
        raise ValueError("evidence holds a number that is not finite")
    if value is None or isinstance(value, (bool, int, float, str, Decimal, date)):
        return json_safe(value)
    raise TypeError(f"evidence holds a {type(value).__name__}")


def unique_keys(pairs: Iterable[tuple]) -> dict:
    """For ``json.loads(object_pairs_hook=...)``: a repeated key is an error."""
    pairs = list(pairs)
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("an object repeats a key")
    return out


def load_json(text: str | bytes):
    def refuse(name):
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=unique_keys, parse_constant=refuse)


def key_words(key: str) -> str:
    """A key as words between underscores: ``goldMetric`` is ``_gold_metric_``."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key)
    return "_" + "_".join(re.findall(r"[a-z0-9]+", spaced.lower())) + "_"


def forbidden_keys(value, path: str = "$") -> list[str]:
    """Paths of the keys, at any depth, that hold a forbidden word."""
    if isinstance(value, Mapping):
        found = [f"{path}.{k}" for k in value if any(f"_{word}_" in key_words(k) for word in FORBIDDEN_KEYS)]
        return found + [p for k, v in value.items() for p in forbidden_keys(v, f"{path}.{k}")]
    if isinstance(value, (list, tuple)):
        return [p for k, v in enumerate(value) for p in forbidden_keys(v, f"{path}[{k}]")]
    return []


def total_usage(usages: Iterable[Mapping[str, int] | None]) -> dict[str, int] | None:
    """Sums of token counts over the calls that report them; null if none does."""
    known = [u for u in usages if u is not None]
    return {k: sum(u[k] for u in known) for k in ("prompt_tokens", "completion_tokens", "total_tokens")} if known else None
