"""Stages of a plan, told to a callback as they begin and end, with counters taken in the pass that writes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation

from ..sources.kept import kept

#: What is told: a stage's key, 'start' or 'done', and a text.
StageHook = Callable[[str, str, str], None]


@dataclass
class Stages:
    """Runs stages one after the other. Each table that a stage keeps is written once; its counters are
    observed by that write, so nothing is scanned for them. A hook that is None hears nothing."""

    hook: StageHook | None = None
    counters: dict[str, int] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)

    def start(self, key: str) -> None:
        if self.hook:
            self.hook(key, "start", "")

    def keep(self, df: DataFrame, name: str, **counters: Column) -> DataFrame:
        """df as a written table; counters are aggregates over its rows, 0 where there are none."""
        if not counters:
            return kept(df, name)
        seen = Observation()
        out = kept(df.observe(seen, *(c.alias(k) for k, c in counters.items())), name)
        self.counters |= {k: v or 0 for k, v in seen.get.items()}
        return out

    def done(self, key: str, text: str) -> None:
        self.texts.append(text)
        if self.hook:
            self.hook(key, "done", text)
