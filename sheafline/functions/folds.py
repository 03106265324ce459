"""Greedy grouping, the fold that splitting, packing and windowing share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TypeVar

T = TypeVar("T")


def grouped(parts: Iterable[T], fits: Callable[[list[T], T], bool]) -> list[list[T]]:
    """Groups of consecutive parts: a part joins the open group if it fits there, else it opens the next."""
    out: list[list[T]] = []
    for part in parts:
        if out and fits(out[-1], part):
            out[-1].append(part)
        else:
            out.append([part])
    return out
