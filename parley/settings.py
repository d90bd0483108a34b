"""Settings from the environment and a ``.env`` file, read on the driver when asked for."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from .errors import SettingsError


@dataclass(frozen=True)
class Settings:
    """What a session needs. ``api_key`` isn't shown and never goes into Spark's configuration."""

    api_key: str = field(repr=False, default="")
    base_url: str | None = None
    model: str = "gpt-4o-mini"
    document: str = "sample.md"
    timeout_s: float = 60.0
    max_retries: int = 0
    temperature: float = 0.0
    large_document: int = 30_000


def read_dotenv(path: str | Path = ".env") -> dict[str, str]:
    """Names and values of a ``.env`` file: ``NAME=value`` lines, ``export`` allowed, ``#`` comments, quotes
    taken off. A missing file has none."""
    values: dict[str, str] = {}
    file = Path(path)
    for line in file.read_text(encoding="utf-8").splitlines() if file.is_file() else ():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if not equals or not name or name.startswith("#"):
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        else:
            value = value.partition(" #")[0].rstrip()
        values[name] = value
    return values


def load_settings(env: Mapping[str, str] | None = None, dotenv: str | Path | None = ".env") -> Settings:
    """Settings from ``env`` (the process's, by default) before those from ``dotenv``.

    A missing or empty key is a SettingsError. The document's default holds only where its variable is unset;
    an empty one stays empty. The service's address has no default: text leaves only for where it is told to.
    """
    found = {**(read_dotenv(dotenv) if dotenv else {}), **(os.environ if env is None else env)}
    if not found.get("OPENAI_API_KEY"):
        raise SettingsError("OPENAI_API_KEY is not set")
    return Settings(api_key=found["OPENAI_API_KEY"], base_url=found.get("OPENAI_BASE_URL") or None, document=found.get("MD_FILE", Settings.document))
