"""The saved baseline of the regression gate."""

from __future__ import annotations

import json
import math
import os
from dataclasses import asdict, dataclass, fields


class BaselineError(ValueError):
    """A baseline that can't be used; ``code`` names the reason."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Baseline:
    schema_version: int = 1
    quality_signal: float = 0.0
    cycle_count: int = 0
    max_depth: int = 0
    total_functions: int = 0
    dead_functions: int = 0
    duplicate_functions: int = 0

    def validate(self) -> Baseline:
        if self.schema_version != 1:
            raise BaselineError("UnsupportedBaselineSchema")
        n, twice = self.total_functions, self.duplicate_functions
        if not (math.isfinite(self.quality_signal) and 0 <= self.quality_signal <= 1) or self.dead_functions > n or twice > n or n and twice >= n:
            raise BaselineError("InvalidBaseline")
        return self


def dumps(baseline: Baseline) -> str:
    return json.dumps(asdict(baseline.validate()), indent=2)


def loads(text: str) -> Baseline:
    """A baseline from JSON with no other keys than its own; missing ones have their defaults."""
    try:
        found = json.loads(text)
    except ValueError:
        raise BaselineError("InvalidBaseline") from None
    kinds = {f.name: (int, float) if f.name == "quality_signal" else int for f in fields(Baseline)}
    good = isinstance(found, dict) and all(k in kinds and isinstance(v, kinds[k]) and not isinstance(v, bool) for k, v in found.items())
    if not good or any(not 0 <= v < 1 << 32 for k, v in found.items() if k != "quality_signal"):
        raise BaselineError("InvalidBaseline")
    return Baseline(**found | {"quality_signal": float(found.get("quality_signal", 0.0))}).validate()


def save(baseline: Baseline, path: str) -> None:
    """Writes the file whole or not at all."""
    text = dumps(baseline)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)
