"""A bounded memo for the workers' inner loops."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """key -> make(key), in two generations of ``limit`` entries; an entry unused for a whole generation goes.

    Keys of more than ``longest`` items are computed anew each time, so memory has a fixed bound.
    """

    def __init__(self, make: Callable, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found
