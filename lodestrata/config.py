"""Settings of a deployment, passed as a value; nothing reads the environment behind the caller's back."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from .profile import DEFAULT


@dataclass(frozen=True)
class Config:
    default_version: str = DEFAULT.default_version
    expand_neighbours: bool = False
    store: str = "data/store"
    chunks: str = "data/chunks"
    model: str = "hashing"
    keywords: str = "data/keywords"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        version = env.get("LODESTRATA_VERSION", cls.default_version)
        return cls(
            "" if version == "all" else version,
            env.get("LODESTRATA_EXPAND", "").lower() in ("1", "true", "yes"),
            env.get("LODESTRATA_STORE", cls.store),
            env.get("LODESTRATA_CHUNKS", cls.chunks),
            env.get("LODESTRATA_MODEL", cls.model),
            env.get("LODESTRATA_KEYWORDS", cls.keywords),
        )
