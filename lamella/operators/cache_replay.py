"""Byte-budget LRU caches, replayed over a trace: one ordered pass for each reader."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame

from lamella.functions.fold import folded


class ByteLru:
    """Least recently used entries go until a new one fits; one larger than the budget is not kept."""

    def __init__(self, budget: int):
        self.budget, self.held, self.entries = budget, 0, OrderedDict()

    def get(self, key) -> bool:
        if key in self.entries:
            self.entries.move_to_end(key)
            return True
        return False

    def put(self, key, size: int) -> int:
        """How many entries went."""
        if size > self.budget:
            return 0
        self.held -= self.entries.pop(key, 0)
        gone = 0
        while self.held + size > self.budget:
            self.held -= self.entries.popitem(last=False)[1]
            gone += 1
        self.entries[key] = size
        self.held += size
        return gone


def replay(trace: DataFrame, budget: int) -> DataFrame:
    """trace: reader, ts, seq, key, bytes. Adds hit, evicted and held after each request. State is a reader's, and no larger
    than its budget allows; traces of any length stream through."""

    def step(cache: ByteLru, row) -> list[tuple]:
        hit = cache.get(row.key)
        gone = 0 if hit else cache.put(row.key, int(row.bytes))
        return [(row.reader, row.seq, row.key, hit, gone, cache.held)]

    rows = trace.select("reader", "ts", "seq", "key", "bytes")
    return folded(rows, ["reader"], ["ts", "seq"], lambda: ByteLru(budget), step, None, "reader long, seq long, key string, hit boolean, evicted long, held long")
