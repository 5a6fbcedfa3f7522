"""A bounded memo of two generations, for pieces of text that repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any


class Memo:
    """Values by key; ``fill`` computes a list of missing keys at once.

    What stays takes at most about twice ``most`` bytes, however long the keys
    are: when the young generation is full it becomes the old one, and what is
    used again moves back.
    """

    #: Bytes that an entry takes beside the characters of its key.
    ENTRY = 200

    def __init__(self, fill: Callable[[list[str]], Iterable[Any]], most: int = 96 << 20):
        self.fill, self.most, self.size = fill, most, 0
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def learn(self, keys: Iterable[str]) -> None:
        """After this, ``self.young`` holds every one of the keys."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        young, old = self.young, self.old
        missing = {k for k in keys if k not in young}
        absent = []
        for k in missing:
            if (v := old.get(k)) is None:
                absent.append(k)
            else:
                young[k] = v
        self.size += self.ENTRY * len(missing) + 4 * sum(map(len, missing))
        if absent:
            young.update(zip(absent, self.fill(absent), strict=True))
