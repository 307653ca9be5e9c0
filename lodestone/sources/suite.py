"""Question suites and settings, read strictly on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

LOW, HIGH = 256, 12_000


@dataclass(frozen=True)
class Question:
    question: str
    expected_paths: list[str] = field(default_factory=list)
    expected_symbols: list[str] = field(default_factory=list)
    max_tokens: int = 0


def _known(cls: type, values: dict) -> dict:
    if unknown := set(values) - {f.name for f in fields(cls)}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return values


def read_suite(text: str) -> list[Question]:
    """A JSON array of questions; unknown fields, an empty array, a blank question and tokens out of bounds are errors."""
    rows = json.loads(text)
    if not isinstance(rows, list) or not rows:
        raise ValueError("a suite is an array of questions")
    suite = [Question(**_known(Question, r)) for r in rows]
    for q in suite:
        if not q.question.strip():
            raise ValueError("a question is required")
        if q.max_tokens and not LOW <= q.max_tokens <= HIGH:
            raise ValueError(f"max_tokens must be 0 or {LOW}..{HIGH}")
    return suite


@dataclass(frozen=True)
class Settings:
    """What an engine may be told; bounds are checked when it is made."""

    max_tokens: int = 3500
    graph_depth: int = 2
    dim: int = 64
    exclude_dirs: tuple[str, ...] = ()
    exclude_names: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    include_tests: bool = False
    max_file_bytes: int = 2 * 1024 * 1024

    def __post_init__(self) -> None:
        if not LOW <= self.max_tokens <= HIGH:
            raise ValueError(f"max_tokens must be {LOW}..{HIGH}")
        if self.graph_depth not in (1, 2):
            raise ValueError("graph_depth must be 1 or 2")

    @classmethod
    def from_yaml(cls, text: str) -> Settings:
        import yaml

        values = yaml.safe_load(text) or {}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in _known(cls, values).items()})
