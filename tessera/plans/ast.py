"""Trees of the condition, projection and update languages."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Path:
    """Names (str) and list places (int), from the attribute inwards."""

    steps: tuple[str | int, ...]

    @property
    def name(self) -> str:
        return str(self.steps[0])


@dataclass(frozen=True)
class Value:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Between:
    operand: object
    low: object
    high: object


@dataclass(frozen=True)
class In:
    operand: object
    choices: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Bare:
    """An operand where a condition should be; never true."""

    operand: object


@dataclass(frozen=True)
class Sum:
    """first, then (sign, operand) from left to right."""

    first: object
    rest: tuple


@dataclass(frozen=True)
class Assign:
    path: Path
    operand: object


@dataclass(frozen=True)
class Update:
    """Steps of one clause: kind is SET, REMOVE, ADD or DELETE."""

    kind: str
    path: Path
    operand: object | None
