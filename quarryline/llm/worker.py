"""Memory of Python workers, which Spark keeps from stage to stage, and of the driver after a fit.

What one operator remembers is of no use to the next one, and what it has freed the allocators keep.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import pyarrow as pa

_clear: dict[str, Callable[[], object]] = {}


def give_back() -> None:
    """Returns freed memory to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def begin(operator: str, clear: Callable[[], object] | None = None) -> None:
    """Called first in a task: forgets what other operators remember. clear: forgets what this one does."""
    for other in [o for o in _clear if o != operator]:
        _clear.pop(other)()
    if clear is not None:
        _clear[operator] = clear
    give_back()


ALPHANUMERIC = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters, in the sense of str.isalpha; the pattern takes number signs such as superscripts, fractions and Roman numerals for some."""
    found = ALPHANUMERIC.findall(text)
    if not found or "".join(found).isalpha():
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]
