"""Process decorators, and the order in which a component's processes run."""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable
from dataclasses import dataclass

#: The steps of the default schedule: a row each, in which later steps run later (fixed values).
DEFAULT_SCHEDULE = (
    ("priorbalance", "selfbalance"),
    ("stepinit", "rate", "totalrate", "state", "totalstate"),
    ("axial",),
    ("potential", "deficit", "allocation", "actual", "segmentation", "postsegmentation"),
)
TOTAL = {"totalrate", "totalstate"}
SIDE_EFFECT = {"priorbalance", "selfbalance", "stepinit"}
_MARK = "__stepframe_steps__"


@dataclass(frozen=True)
class Process:
    name: str
    function: Callable
    steps: tuple[str, ...]
    owner: str
    position: int

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(inspect.signature(self.function).parameters)[1:]

    @property
    def _first(self) -> str:
        """With several steps, the alphabetically first says whether the process is a total or a side effect."""
        return min(self.steps)

    @property
    def total(self) -> bool:
        return self._first in TOTAL

    @property
    def side_effect(self) -> bool:
        return self._first in SIDE_EFFECT or not self.inputs

    @property
    def many(self) -> bool:
        hint = inspect.signature(self.function).return_annotation
        return typing.get_origin(hint) is tuple or str(hint).startswith("tuple[")


def step(name: str) -> Callable:
    """A decorator that registers a method in the step ``name``."""

    def mark(function: Callable) -> Callable:
        setattr(function, _MARK, (*getattr(function, _MARK, ()), name))
        return function

    mark.__name__ = name
    return mark


priorbalance, selfbalance = step("priorbalance"), step("selfbalance")
stepinit, rate, totalrate, state, totalstate = map(step, DEFAULT_SCHEDULE[1])
axial = step("axial")
potential, deficit, allocation, actual, segmentation, postsegmentation = map(step, DEFAULT_SCHEDULE[3])


def processes(component: type) -> list[Process]:
    """A class's processes with those it inherits; a method of the same name replaces its parent's."""
    found: dict[str, Process] = {}
    for owner in reversed(component.__mro__):
        for name, f in vars(owner).items():
            if hasattr(f, _MARK):
                found[name] = Process(name[1:], f, getattr(f, _MARK), owner.__name__, len(found))
            elif name in found and not hasattr(f, _MARK):
                del found[name]
    return list(found.values())


def priority(process: Process, schedule=DEFAULT_SCHEDULE) -> tuple[int, ...]:
    return tuple(max([row.index(s) + 1 for s in process.steps if s in row], default=0) for row in schedule)


def ordered(found: list[Process], schedule=DEFAULT_SCHEDULE, as_text: bool = False) -> list[tuple[tuple[int, ...], list[Process]]]:
    """Groups of equal priority in the order they run; within one by step name, then by registration.

    ``as_text`` compares priorities as text, which differs from numbers only in rows of ten steps or more.
    """
    groups: dict[tuple[int, ...], list[Process]] = {}
    for p in sorted(found, key=lambda p: (min(p.steps), p.position)):
        groups.setdefault(priority(p, schedule), []).append(p)
    return sorted(groups.items(), key=lambda x: str(list(x[0])) if as_text else x[0])
