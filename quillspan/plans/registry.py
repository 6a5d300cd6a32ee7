"""Named retrievers and composers: functions that the caller may extend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Component:
    kind: str
    name: str
    description: str
    run: Callable
    selectable: bool = True


_FOUND: dict[tuple[str, str], Component] = {}


def register(kind: str, name: str, description: str = "", selectable: bool = True):
    """Decorator; a second component of one kind and name is an error."""

    def add(run: Callable) -> Callable:
        if (kind, name) in _FOUND:
            raise ValueError(f"{kind} {name} is already registered")
        _FOUND[kind, name] = Component(kind, name, description, run, selectable)
        return run

    return add


def component(kind: str, name: str) -> Component:
    if (kind, name) not in _FOUND:
        raise KeyError(f"no {kind} {name}; there are: {', '.join(n for k, n in sorted(_FOUND) if k == kind)}")
    return _FOUND[kind, name]


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _FOUND if k == kind and _FOUND[k, n].selectable)
