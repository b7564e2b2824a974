"""Settings with typed defaults, overridden by the environment or a .env file."""

from __future__ import annotations

import dataclasses
import os
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Settings:
    embed_model: str = "text-embedding-3-large"
    embed_dim: int = 1536
    embed_price_usd_per_1k_tokens: float = 0.00013
    embed_max_concurrency: int = 4
    embed_batch_size: int = 96
    embed_base_url: str = ""
    embed_api_key: str = ""

    @classmethod
    def load(cls, env_file: str | None = ".env") -> Settings:
        """Fields by their upper-case names; the environment wins over the file, unknown names are ignored."""
        found = {}
        if env_file and Path(env_file).is_file():
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    found[name.strip().upper()] = value.strip().strip("\"'")
        found |= {k.upper(): v for k, v in os.environ.items()}
        kinds = {"str": str, "int": int, "float": float}
        return cls(**{f.name: kinds[f.type](found[f.name.upper()]) for f in dataclasses.fields(cls) if f.name.upper() in found})
