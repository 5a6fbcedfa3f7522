"""Definitions of tables and indexes, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from .values import ValidationError

PROJECTIONS = ("ALL", "KEYS_ONLY", "INCLUDE")
VIEWS = ("KEYS_ONLY", "NEW_IMAGE", "OLD_IMAGE", "NEW_AND_OLD_IMAGES")


@dataclass(frozen=True)
class Index:
    name: str
    hash_key: str
    range_key: str | None = None
    projection: str = "ALL"
    include: tuple[str, ...] = ()
    local: bool = False

    def __post_init__(self) -> None:
        if self.projection not in PROJECTIONS:
            raise ValidationError(f"no projection {self.projection!r}")

    @property
    def keys(self) -> list[str]:
        return [self.hash_key, *([self.range_key] if self.range_key else [])]


@dataclass(frozen=True)
class Table:
    """key_types: a tag (S, N or B) for every attribute of a key."""

    name: str
    hash_key: str
    range_key: str | None = None
    key_types: dict[str, str] = field(default_factory=dict)
    indexes: tuple[Index, ...] = ()
    ttl: str | None = None
    stream_view: str | None = None
    billing: str = "PAY_PER_REQUEST"
    read_units: int = 0
    write_units: int = 0
    created: float = 0.0
    backups_on: bool = False
    sets: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        for name in {k for i in self.indexes for k in i.keys} | set(self.keys):
            if self.key_types and self.key_types.get(name) not in ("S", "N", "B"):
                raise ValidationError(f"the key attribute {name} has no type")
        if len({i.name for i in self.indexes}) < len(self.indexes):
            raise ValidationError("index names repeat")

    @property
    def keys(self) -> list[str]:
        return [self.hash_key, *([self.range_key] if self.range_key else [])]

    def index(self, name: str) -> Index:
        for i in self.indexes:
            if i.name == name:
                return i
        raise ValidationError(f"no index {name!r}")

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"sets": sorted(self.sets)}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Table:
        x: dict[str, Any] = json.loads(text)
        x["indexes"] = tuple(Index(**i | {"include": tuple(i["include"])}) for i in x["indexes"])
        x["sets"] = frozenset(x["sets"])
        return Table(**x)

    def with_(self, **changes: Any) -> Table:
        return replace(self, **changes)
