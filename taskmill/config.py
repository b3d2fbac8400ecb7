"""Settings of a session, from the environment; checked as they are read, secrets never shown."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from functools import cache
from pathlib import Path

from taskmill.functions import PLACEHOLDER

# Where models are asked and which, unless told otherwise; tasks asked at once.
BASE_URL = "https://api.openai.com/v1"
MODEL = "gpt-5.6-luna"
EFFORT = "medium"
CONCURRENCY, LEAST_CONCURRENCY, MOST_CONCURRENCY = 4, 1, 128

PREFIX = "TASKMILL_"


def _text(value: str, root: Path) -> str:
    return value


def _folder(value: str, root: Path) -> str:
    """An absolute path; a relative one begins at root."""
    return os.path.normpath(root / value)


def _concurrency(value: str, root: Path) -> int:
    n = int(value)
    if n not in range(LEAST_CONCURRENCY, MOST_CONCURRENCY + 1):
        raise ValueError(f"concurrency must be from {LEAST_CONCURRENCY} to {MOST_CONCURRENCY}")
    return n


def _setting(default, read: Callable = _text, **options):
    """A field, and how its text in the environment is read."""
    return field(default=default, metadata={"read": read}, **options)


@dataclass(frozen=True)
class Settings:
    """Frozen settings. load() reads them; folders are absolute then."""

    api_key: str = _setting("", repr=False)
    base_url: str = _setting(BASE_URL)
    model: str = _setting(MODEL)
    reasoning_effort: str = _setting(EFFORT)
    source_dir: str = _setting("upstream", _folder)
    release_dir: str = _setting("release", _folder)
    runtime_dir: str = _setting("data/runtime", _folder)
    dataset_file: str = _setting("tasks.json")
    concurrency: int = _setting(CONCURRENCY, _concurrency)

    @property
    def dataset_path(self) -> str:
        return f"{self.release_dir}/data/{self.dataset_file}"

    @property
    def api_key_configured(self) -> bool:
        """The rule of functions.has_secret(): no key counts as a placeholder."""
        return not (self.api_key or PLACEHOLDER).startswith(PLACEHOLDER)


def dotenv_values(text: str) -> dict[str, str]:
    """NAME=value lines; blank lines, comments and quotes around values are left out."""
    pairs = (line.partition("=") for line in text.splitlines() if not line.lstrip().startswith("#"))
    return {name.strip(): value.strip().strip("\"'") for name, found, value in pairs if found}


def load(env: Mapping[str, str] | None = None, dotenv: str | None = None, root: str | None = None) -> Settings:
    """Settings from TASKMILL_* variables over those of a .env file; other names are ignored.

    root: where relative folders begin, the working directory unless given.
    """
    held = dotenv_values(Path(dotenv).read_text(encoding="utf-8")) if dotenv and Path(dotenv).is_file() else {}
    held |= os.environ if env is None else env
    base = Path(root or ".").absolute()
    return Settings(**{f.name: f.metadata["read"](str(held.get(PREFIX + f.name.upper(), f.default)), base) for f in fields(Settings)})


@cache
def settings() -> Settings:
    return load(dotenv=".env")
