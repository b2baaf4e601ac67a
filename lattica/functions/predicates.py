"""Stopping predicates for iterative algorithms; combine them with ``&`` and ``|``."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class State:
    """What an iteration ends with. Fields an algorithm does not know stay None."""

    iteration: int = 0
    l1: float | None = None
    linf: float | None = None
    gain: float | None = None
    mean_improvement: float | None = None
    modified: int | None = None
    nodes: int = 0
    arcs: int = 0


class Stop:
    """A predicate on State: true means stop."""

    def __init__(self, test: Callable[[State], bool], name: str):
        self._test, self.name = test, name

    def __call__(self, state: State) -> bool:
        return bool(self._test(state))

    def __and__(self, other: Stop) -> Stop:
        return Stop(lambda s: self(s) and other(s), f"({self.name} and {other.name})")

    def __or__(self, other: Stop) -> Stop:
        return Stop(lambda s: self(s) or other(s), f"({self.name} or {other.name})")

    def __repr__(self) -> str:
        return self.name


def _at_most(field: str, limit: float) -> Stop:
    def test(s: State) -> bool:
        value = getattr(s, field)
        return value is not None and value <= limit

    return Stop(test, f"{field} <= {limit}")


def _positive(threshold: float) -> float:
    if math.isnan(threshold) or threshold <= 0:
        raise ValueError(f"the threshold must be positive: {threshold}")
    return threshold


def max_iterations(k: int) -> Stop:
    return Stop(lambda s: s.iteration >= k, f"iteration >= {k}")


def l1_norm(threshold: float = 1e-6) -> Stop:
    return _at_most("l1", _positive(threshold))


def linf_norm(threshold: float = 1e-6) -> Stop:
    return _at_most("linf", _positive(threshold))


def max_updates(k: int) -> Stop:
    return Stop(lambda s: s.iteration + 1 >= k, f"updates >= {k}")


def _number(threshold: float) -> float:
    if math.isnan(threshold):
        raise ValueError("the threshold must be a number")
    return threshold


def min_gain(threshold: float = 1e-3) -> Stop:
    return _at_most("gain", _number(threshold))


def min_mean_improvement(threshold: float = 0.1) -> Stop:
    return _at_most("mean_improvement", _number(threshold))


def few_modified() -> Stop:
    """At most the square root of the number of nodes changed."""
    return Stop(lambda s: s.modified is not None and s.modified <= math.sqrt(s.nodes), "modified <= sqrt(nodes)")


def percent_modified(percent: float) -> Stop:
    if not 0 <= percent <= 100:
        raise ValueError(f"a percentage is between 0 and 100: {percent}")
    return Stop(lambda s: s.modified is not None and s.modified <= percent / 100 * s.nodes, f"modified <= {percent} %")
