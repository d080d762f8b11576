"""What needs a library, model or service that may be missing: one instance a worker, retries, and identity where it fails."""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable
from typing import Any

_ONCE: dict[str, Any] = {}


def once(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in this process; None, also from then on, where it fails."""
    if name not in _ONCE:
        try:
            _ONCE[name] = make()
        except Exception:
            _ONCE[name] = None
    return _ONCE[name]


def forget(name: str) -> None:
    """Lets ``once`` make it again."""
    _ONCE.pop(name, None)


def library(name: str) -> Any:
    """A module, or None where it is not installed."""
    return once(f"module {name}", lambda: importlib.import_module(name))


def retried(call: Callable[[], Any], attempts: int = 3, low: float = 2.0, high: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What ``call`` gives, after up to ``attempts`` tries with waits that double from ``low`` to ``high`` seconds; the last error is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i + 1 == attempts:
                raise
            sleep(min(high, low * 2**i) * random.uniform(0.9, 1.0))
    raise ValueError("no attempts")


def or_same(change: Callable[[str], str] | None, text: str) -> str:
    """The changed text; the text itself where there is no change to make, or it fails or gives nothing."""
    if change is None:
        return text
    try:
        return change(text) or text
    except Exception:
        return text


def unicode_fix() -> Callable[[str], str] | None:
    """Encoding repair by its library; None without it."""
    lib = library("ftfy")
    return lib.fix_text if lib else None


def grammar_fix(language: str = "en-US") -> Callable[[str], str] | None:
    """Grammar correction by its library; None without it."""
    lib = library("language_tool_python")
    tool = once(f"grammar {language}", lambda: lib.LanguageTool(language)) if lib else None
    return tool.correct if tool else None
