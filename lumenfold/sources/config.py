"""Configurations of the generator from YAML."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from .generate import Anomaly, Config

#: The keys of a configuration, of an anomaly, and what else it must say.
KEYS = {"dataset_version", "schema_version", "source_label", "seed", "start_date", "days", "product_count", "customer_count", "categories", "regions", "channels", "anomalies"}
ANOMALY_KEYS = {"anomaly_id", "kind", "product_id", "start_day", "end_day", "multiplier"}
SCHEMA_VERSION, SOURCE_LABEL = "1.0", "Synthetic E-commerce Data"


@dataclass(frozen=True)
class DataConfig:
    version: str
    config: Config
    sha256: str


def load(path: str | Path) -> DataConfig:
    """A checked configuration with the hash of the file's bytes; anything unknown, missing or of another type is a
    ValueError."""
    import yaml

    raw = Path(path).read_bytes()
    top = yaml.safe_load(raw.decode("utf-8"))
    optional = {"schema_version", "source_label"}
    if not isinstance(top, dict) or set(top) - KEYS or KEYS - optional - set(top):
        raise ValueError(f"a configuration has the keys {sorted(KEYS)}")
    if top.get("schema_version", SCHEMA_VERSION) != SCHEMA_VERSION or top.get("source_label", SOURCE_LABEL) != SOURCE_LABEL:
        raise ValueError("another schema version or source label")
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    if not all(whole(top[k]) for k in ("seed", "days", "product_count", "customer_count")) or type(top["start_date"]) is not date:
        raise ValueError("seed, days and counts are whole numbers, start_date a date")
    anomalies = []
    for a in top["anomalies"] if isinstance(top["anomalies"], list) else [None]:
        if not isinstance(a, dict) or set(a) != ANOMALY_KEYS:
            raise ValueError(f"an anomaly has the keys {sorted(ANOMALY_KEYS)}")
        if not whole(a["start_day"]) or not whole(a["end_day"]) or isinstance(a["multiplier"], bool) or not isinstance(a["multiplier"], (int, float)):
            raise ValueError(f"{a['anomaly_id']}: days and multiplier are numbers")
        anomalies.append(Anomaly(a["kind"], a["product_id"], a["start_day"], a["end_day"], float(a["multiplier"]), a["anomaly_id"]))
    lists = {}
    for k in ("categories", "regions", "channels"):
        if not isinstance(top[k], list) or not all(isinstance(x, str) for x in top[k]):
            raise ValueError(f"{k} is a list of names")
        lists[k] = tuple(top[k])
    config = Config(top["seed"], top["start_date"], top["days"], top["product_count"], top["customer_count"], tuple(anomalies), **lists)
    return DataConfig(_version(top["dataset_version"]), config, hashlib.sha256(raw).hexdigest())


def _version(value) -> str:
    parts = value.split("-") if isinstance(value, str) else [""]
    if not all(p and p.isascii() and p.isalnum() and p == p.lower() for p in parts):
        raise ValueError("a version is lower-case words and numbers joined by hyphens")
    return value
