"""Settings of a run: a file in YAML, TOML or JSON, read by nested names, with environment variables and defaults around it."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable
from pathlib import Path


class Settings:
    def __init__(self, path: str | None = None, environ: dict[str, str] | None = None):
        self.environ = dict(os.environ) if environ is None else environ
        self.values = _read(Path(path)) if path else {}

    def get(self, *names: str, default=None):
        """The value at a path of names; the default where a step or the value is missing."""
        node = self.values
        for n in names:
            node = node.get(n) if isinstance(node, dict) else None
            if node is None:
                return default
        return node

    def of(self, *names: str, env: str | None = None, default=None, kind: Callable = str):
        """The environment's value, or the file's, or the default, as kind."""
        if env and env in self.environ:
            return kind(self.environ[env])
        found = self.get(*names, default=default)
        return None if found is None else kind(found)


def _read(path: Path) -> dict:
    """The file's content; an absent or empty file has none."""
    if not path.exists():
        return {}
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".toml":
        return tomllib.loads(text)
    if path.suffix == ".json":
        return json.loads(text or "{}")
    import yaml

    return yaml.safe_load(text) or {}


#: Names, environment variables, defaults and kinds of the settings that the command line and batch runs use.
KNOWN = {
    "top_k": (("retrieval", "bm25", "top_k"), None, 3, int),
    "fallback_k": (("retrieval", "bm25", "fallback_k"), None, 5, int),
    "batch_size": (("agent", "batch_size"), "LONGLEAF_BATCH_SIZE", 5, int),
    "token_budget": (("agent", "token_budget"), "TOKEN_BUDGET", 5_000_000, int),
    "index_dir": (("retrieval", "bm25", "index_dir"), "LONGLEAF_INDEX", "data/index", str),
    "output_dir": (("output", "dir"), "LONGLEAF_OUTPUT", "output", str),
}


def known(settings: Settings) -> dict[str, object]:
    return {name: settings.of(*names, env=env, default=default, kind=kind) for name, (names, env, default, kind) in KNOWN.items()}
