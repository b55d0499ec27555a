"""Configuration on the driver: bad values fall back to defaults one by one, with a warning for each."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from pathlib import Path

from chaffsieve.functions.decisions import Thresholds

MODES = ("off", "on", "test")
DESCRIPTION_UNITS = 8192


@dataclass(frozen=True)
class FilterConfig:
    """The defaults."""

    mode: str = "on"
    page_drop: float = Thresholds.page_drop
    group_keep: float = Thresholds.group_keep
    single_keep: float = Thresholds.single_keep
    timeout_ms: int = 15000
    concurrency: int = 12

    @property
    def thresholds(self) -> Thresholds:
        return Thresholds(self.page_drop, self.group_keep, self.single_keep)


def _fit(name: str, value: object) -> object | None:
    if name == "mode":
        return m if isinstance(value, str) and (m := value.strip().lower()) in MODES else None
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        return None
    if name in ("page_drop", "group_keep", "single_keep"):
        return float(value) if 0 <= value <= 1 else None
    most = 2147483647 if name == "timeout_ms" else math.inf
    return int(value) if value == int(value) and 0 < value <= most else None


def parsed(raw: object, warn: Callable[[str], None] = print) -> FilterConfig:
    """Unknown keys are ignored."""
    out = FilterConfig()
    if not isinstance(raw, dict):
        return out
    for f in fields(out):
        if f.name in raw:
            fit = _fit(f.name, raw[f.name])
            if fit is None:
                warn(f"{f.name}: {str(raw[f.name])[:80]!r} is not usable, {getattr(out, f.name)!r} holds")
            else:
                out = replace(out, **{f.name: fit})
    return out


def load(path: str | None = None, warn: Callable[[str], None] = print) -> FilterConfig:
    """The file at `path`, or one in the home folder that is made with mode on where there is none."""
    at = Path(path) if path else Path(os.path.expanduser("~")) / ".chaffsieve" / "config.json"
    if not path and not at.exists():
        try:
            at.parent.mkdir(parents=True, exist_ok=True)
            with at.open("x", encoding="utf-8") as f:
                f.write('{"mode":"on"}')
        except OSError as e:
            warn(f"{at}: {e}")
    try:
        return parsed(json.loads(at.read_text(encoding="utf-8-sig")), warn)
    except (OSError, ValueError) as e:
        warn(f"{at}: {e}")
        return FilterConfig()


def description(fallback: str, path: str | None, warn: Callable[[str], None] = print) -> str:
    """Text of a file of at most DESCRIPTION_UNITS UTF-16 units that is not blank, else the fallback."""
    if not path:
        return fallback
    try:
        text = Path(path).read_text(encoding="utf-8-sig")
    except (OSError, ValueError) as e:
        warn(f"{path}: {e}")
        return fallback
    if not text.strip() or len(text.encode("utf-16-le")) // 2 > DESCRIPTION_UNITS:
        warn(f"{path}: blank or too long")
        return fallback
    return text


def api_key(path: str) -> str | None:
    """First line of a key file, None for a blank or missing one."""
    try:
        return Path(path).read_text(encoding="utf-8-sig").strip().split("\n")[0].strip() or None
    except OSError:
        return None
