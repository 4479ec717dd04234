"""The function library: name -> builder of a typed expression."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..types import TaqlError, Val

#: Builders take the argument values and whether errors turn into null.
REGISTRY: dict[str, Callable[..., Val]] = {}


def register(*names: str, least: int = 0, most: int | None = None) -> Callable[[Callable[..., Val]], Callable[..., Val]]:
    """Add a builder under its names; ``least`` and ``most`` bound the number of arguments."""

    def add(build: Callable[..., Val]) -> Callable[..., Val]:
        def checked(args: list[Val], safe: bool = False) -> Val:
            if len(args) < least or most is not None and len(args) > most:
                raise TaqlError(f"{names[0]} takes {least} to {'any number of' if most is None else most} arguments, not {len(args)}")
            return build(args, safe)

        for n in names:
            REGISTRY[n.upper()] = checked
        return build

    return add


def call(name: str, args: list[Val], safe: bool = False) -> Val:
    if name not in REGISTRY:
        raise TaqlError(f"unknown column or function {name}")
    return REGISTRY[name](args, safe)


def constant(v: Val, what: str) -> Any:
    if v.const is None:
        raise TaqlError(f"{what} must be a constant")
    return v.const


from . import arrays, complexes, dates, mathematics, strings  # noqa: E402,F401
