"""A bounded memory of a function's values within a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable

WORDS = 600_000


class Remembered:
    """Values of ``f`` by key. Two generations: once the younger is full it becomes the older.

    Keys in use move to the younger one, so frequent words stay and memory is bounded by
    twice ``size`` keys of ordinary length; long keys are not kept.
    """

    def __init__(self, f: Callable, size: int = WORDS, longest: int = 64):
        self.f, self.size, self.longest = f, size, longest
        self.young: dict = {}
        self.old: dict = {}

    def one(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.f(key)
                if len(key) > self.longest:
                    return value
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value

    def of(self, keys: Iterable) -> list:
        """Values of many keys; known ones are read without a call for each."""
        keys = list(keys)
        values = list(map(self.young.get, keys))
        if None in values:
            one = self.one
            values = [one(k) if v is None else v for k, v in zip(keys, values)]
        return values
