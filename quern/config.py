"""Run configurations: files of nested keys, with paths and environment variables expanded."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

from quern.plans.pipeline import Settings

#: Other names of the modes.
ALIASES = {"medcpt": "dense", "pubmed": "search"}


def _is_path(key: str) -> bool:
    return key in ("dir", "path", "root") or key.endswith(("_dir", "_path", "_root"))


def expand(value: Any, base: str, key: str = "") -> Any:
    """``value`` with variables and ``~`` expanded in all strings, and relative paths under path-like keys put below ``base``; addresses stay."""
    if isinstance(value, dict):
        return {k: expand(v, base, str(k)) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, base, key) for v in value]
    if not isinstance(value, str):
        return value
    text = os.path.expandvars(value)
    if not _is_path(key) or "://" in text or not text:
        return text
    return str(Path(base, os.path.expanduser(text)))


def load(path: str) -> dict:
    """A JSON file, or YAML where a reader for it is installed; relative paths are below the file's folder."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ValueError("no reader for YAML is installed; write the configuration as JSON") from e
        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    return expand(found, str(Path(path).resolve().parent))


def settings(config: dict, **over: Any) -> Settings:
    """Settings from the sections ``retrieval``, ``compression``, ``model`` and ``live_search``; ``over`` wins, None being no choice."""
    retrieval, compression, model, live = (config.get(k) or {} for k in ("retrieval", "compression", "model", "live_search"))
    found = {
        "mode": retrieval.get("mode"), "k": retrieval.get("k1", retrieval.get("k")), "pool": retrieval.get("pool"), "alpha": retrieval.get("recency_alpha"),
        "compress": compression.get("enabled"), "ratio": compression.get("ratio"), "context_length": model.get("context_length"),
        "models": model.get("names") or ([model["name"]] if model.get("name") else None), "n_votes": model.get("votes"), "live": live.get("enabled"), "live_k": live.get("k"),
    } | {k: v for k, v in over.items() if v is not None}
    found = {k: v for k, v in found.items() if v is not None}
    if "mode" in found:
        found["mode"] = ALIASES.get(found["mode"], found["mode"])
    return Settings(**found)
