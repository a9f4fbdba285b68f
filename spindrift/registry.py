"""Named operators: functions of DataFrames, registered once each."""

from __future__ import annotations

from collections.abc import Callable

_KINDS: dict[str, dict[str, Callable]] = {}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        table = _KINDS.setdefault(kind, {})
        if name in table:
            raise ValueError(f"{kind} {name} is registered already")
        table[name] = f
        return f

    return add


def get(kind: str, name: str) -> Callable:
    if name not in _KINDS.get(kind, {}):
        raise KeyError(f"no {kind} named {name}; there are {sorted(_KINDS.get(kind, {}))}")
    return _KINDS[kind][name]


def names(kind: str) -> list[str]:
    return sorted(_KINDS.get(kind, {}))
