"""Engine configuration from YAML, with its checks."""

from __future__ import annotations

import os
from typing import Any

import yaml

# The keys that a file must have, with their types, and what may be left out.
REQUIRED: dict[str, type] = {
    "app_name": str, "version": str,
    "ingestion.tcp.host": str, "ingestion.tcp.port": int, "ingestion.tcp.maxConnections": int,
    "ingestion.udp.host": str, "ingestion.udp.port": int, "ingestion.udp.bufferSize": int,
    "ingestion.file.path": str, "ingestion.file.poll_interval_ms": int,
    "router.shards": int, "router.strategy": str, "router.buffer_size": int,
    "rule_engine.threads": int, "rule_engine.cache_size": int, "rule_engine.rules_file": str,
    "storage.backend": str, "storage.sqlite_path": str, "python_integration.script_path": str,
}
OPTIONAL: dict[str, Any] = {
    "ingestion.tcp.enable": False, "ingestion.udp.enable": False, "ingestion.file.enable": False, "rule_engine.enable_cache": False, "python_integration.enable": False,
    "plugins.load": [], "numa.enable": False, "control.thresholds.max_queue_depth": 5000, "control.thresholds.max_drop_rate": 2.0, "control.thresholds.max_latency_ms": 100,
}
_MISSING = object()


def _at(tree: Any, path: str) -> Any:
    for name in path.split("."):
        if not isinstance(tree, dict) or name not in tree:
            return _MISSING
        tree = tree[name]
    return tree


def check(tree: dict) -> dict[str, Any]:
    """The settings by dotted name. ValueError names the first that is missing, of another type or out of bounds."""
    out: dict[str, Any] = {}
    for path, kind in REQUIRED.items():
        value = _at(tree, path)
        if value is _MISSING:
            raise ValueError(f"missing configuration key: {path}")
        if kind is int and (isinstance(value, bool) or not isinstance(value, int)):
            raise ValueError(f"{path} isn't a whole number")
        if kind is str and isinstance(value, (dict, list)):
            raise ValueError(f"{path} isn't a text")
        out[path] = str(value) if kind is str else value
    for path, default in OPTIONAL.items():
        value = _at(tree, path)
        out[path] = default if value is _MISSING or value is None else value
        if isinstance(default, bool) and not isinstance(out[path], bool):
            raise ValueError(f"{path} isn't a truth value")
    rules = [
        (0 < out["ingestion.tcp.port"] <= 65535 and 0 < out["ingestion.udp.port"] <= 65535, "a port is out of range"),
        (not out["ingestion.file.enable"] or out["ingestion.file.path"], "file ingestion without a path"),
        (out["router.shards"] > 0 and out["router.buffer_size"] > 0, "router numbers must be positive"),
        (out["rule_engine.threads"] > 0 and out["rule_engine.cache_size"] >= 0, "rule engine numbers are out of range"),
        (out["storage.backend"] in ("sqlite", "filesystem"), "unknown storage backend"),
        (not out["python_integration.enable"] or out["python_integration.script_path"], "Python integration without a path"),
    ]
    for holds, what in rules:
        if not holds:
            raise ValueError(what)
    return out


def load(path: str) -> dict[str, Any]:
    if not os.path.exists(path):
        raise FileNotFoundError(f"configuration file not found: {path}")
    with open(path, encoding="utf-8") as f:
        tree = yaml.safe_load(f)
    if not isinstance(tree, dict):
        raise ValueError("the configuration isn't a mapping")
    return check(tree)


def dead_letter_path(storage_path: str) -> str:
    """The dead-letter text log beside an event log."""
    return os.path.join(os.path.dirname(storage_path), "dlq_log.txt")
