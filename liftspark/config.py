"""Modes and limits. Both only ever tighten."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

MODES = ("off", "observe", "auto")


@dataclass(frozen=True)
class Policy:
    """Budgets of capture and batching; ``tighten`` never raises one."""

    max_nodes: int = 4096
    max_depth: int = 32
    max_inline_depth: int = 4
    max_source_bytes: int = 65536
    max_literal_bytes: int = 4096
    max_table_entries: int = 256
    max_arguments: int = 32
    dictionary_capacity: int = 65536
    cache_capacity: int = 16384
    max_batch_rows: int = 1_000_000
    max_retries: int = 8
    max_schema_fields: int = 4096
    max_reasons: int = 64

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if type(v) is not int or not 0 < v <= f.default * 16:
                raise ValueError(f"{f.name} out of range: {v!r}")

    def tighten(self, **limits: int) -> Policy:
        return replace(self, **{k: min(getattr(self, k), v) for k, v in limits.items()})


@dataclass(frozen=True)
class EngineConfig:
    """off: every function runs as it is; observe: the same, and decisions are recorded; auto: the best tier.

    Precedence: ``disabled`` beats the mode; the mode of a function can only
    lower that of the engine; ``auto`` that isn't authorised is ``observe``."""

    mode: str = "auto"
    disabled: bool = False
    rollout_authorized: bool = True
    policy: Policy = Policy()

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")

    def effective(self, asked: str | None = None) -> str:
        if self.disabled:
            return "off"
        mode = self.mode if asked is None else min(self.mode, asked, key=MODES.index)
        return "observe" if mode == "auto" and not self.rollout_authorized else mode


_current = EngineConfig()


def current() -> EngineConfig:
    return _current


def configure(config: EngineConfig) -> EngineConfig:
    """Sets the engine's configuration and returns the one before."""
    global _current
    before, _current = _current, config
    return before
