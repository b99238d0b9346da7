"""Versioned caches: persisted frames by name and data version, bounded in number and age, least recently used out first.

A frame is cached under the version of the data that it was made of: entries of a `Store`, or the stamp of a table's files.
Asking for it under another version frees the old one and makes it anew, so nothing has to be told that data has changed.
What is freed is unpersisted; a frame that executors lose is computed again from its plan.
"""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any, NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .store import Store


class _Held(NamedTuple):
    version: Hashable
    value: Any
    since: float


class Cache:
    """Values by name, each of one version. make: computes a missing value; keep and release: what is done with a value that
    comes and goes. A time to live of None is none."""

    def __init__(self, most: int = 16, ttl_s: float | None = None, keep: Callable[[Any], Any] = lambda v: v, release: Callable[[Any], None] = lambda v: None, clock: Callable[[], float] = time.monotonic):
        if most < 1:
            raise ValueError("most: 1 or more")
        self.most, self.ttl_s, self._keep, self._release, self._clock = most, ttl_s, keep, release, clock
        self._held: OrderedDict[Hashable, _Held] = OrderedDict()
        self._lock = threading.RLock()
        self.hits = self.misses = self.evicted = self.outdated = self.expired = 0

    def get(self, name: Hashable, version: Hashable, make: Callable[[], Any]) -> Any:
        with self._lock:
            if (held := self._held.get(name)) is not None:
                old = self.ttl_s is not None and self._clock() - held.since >= self.ttl_s
                if held.version == version and not old:
                    self.hits += 1
                    self._held.move_to_end(name)
                    return held.value
                self.expired += held.version == version
                self.outdated += held.version != version
                self._free(name)
            self.misses += 1
            value = self._keep(make())
            self._held[name] = _Held(version, value, self._clock())
            while len(self._held) > self.most:
                self.evicted += 1
                self._free(next(iter(self._held)))
            return value

    def _free(self, name: Hashable) -> None:
        self._release(self._held.pop(name).value)

    def clear(self, name: Hashable | None = None) -> int:
        """Free one value, or all; how many."""
        with self._lock:
            names = [n for n in list(self._held) if name is None or n == name]
            for n in names:
                self._free(n)
            return len(names)

    def stats(self) -> dict[str, Any]:
        with self._lock:
            asked = self.hits + self.misses
            return {"size": len(self._held), "most": self.most, "names": [str(n) for n in self._held], "hits": self.hits, "misses": self.misses, "hit_rate": round(self.hits / asked, 4) if asked else 0.0, "evicted": self.evicted, "outdated": self.outdated, "expired": self.expired}


def frames(most: int = 16, ttl_s: float | None = None, clock: Callable[[], float] = time.monotonic) -> Cache:
    """A cache of DataFrames, persisted in memory and on disk as they are first computed."""
    return Cache(most, ttl_s, keep=lambda df: df.persist(StorageLevel.MEMORY_AND_DISK), release=lambda df: df.unpersist(), clock=clock)


def data_version(store: Store, *tables: str) -> tuple[int, ...]:
    """The version of stored tables together: it changes with every write, append and compaction of any of them, and so
    with every batch that a stream's foreachBatch stores."""
    return tuple(store.entry(t)["entry"] for t in tables)


def stored(cache: Cache, store: Store, name: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """make(a stored table) from the cache, as of the table's last entry."""
    (version,) = data_version(store, name)
    return cache.get(name, version, lambda: make(store.read(name, entry=version)))
