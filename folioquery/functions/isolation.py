"""Calls of user models in which one bad input does not take the others with it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

MESSAGE = 300  # characters of an error that are kept


def call_isolated(model: Callable[[list], Sequence], inputs: list, check: Callable[[Any], str | None]) -> list[tuple[Any, str | None]]:
    """(result, error) of each input. A call that fails is halved until the inputs that fail stand alone.

    `check` says what is wrong with a single result. With b bad inputs of n there are about b log n calls.
    """
    if not inputs:
        return []
    try:
        results = list(model(inputs))
        if len(results) != len(inputs):
            raise ValueError(f"expected {len(inputs)} results, got {len(results)}")
        return [(result, None) if (wrong := check(result)) is None else (None, wrong) for result in results]
    except Exception as error:  # noqa: BLE001  (whatever a user's model raises)
        if len(inputs) == 1:
            return [(None, f"{type(error).__name__}: {error}"[:MESSAGE])]
    half = len(inputs) // 2
    return call_isolated(model, inputs[:half], check) + call_isolated(model, inputs[half:], check)
