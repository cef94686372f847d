"""Tasks that give memory back when they end.

Spark reuses Python workers for every operator of a session. What a task has freed stays
with the process, and what an earlier operator remembers (the tokens of pieces) stays alive,
while the executor's JVM and the next operator need the room.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def forget() -> None:
    """Drop what the tokenizing operators remember in this worker."""
    memo = sys.modules.get("keyscape.llm.memo")
    if memo:
        memo.forget()


def batches(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` whose tasks start without the memory of others and end
    without their own."""

    @wraps(f)
    def run(rows: Iterator) -> Iterator:
        forget()
        yield from f(rows)
        give_back()

    return run


def table(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for ``applyInArrow`` on groups."""

    @wraps(f)
    def run(rows: pa.Table) -> pa.Table:
        forget()
        out = f(rows)
        give_back()
        return out

    return run
