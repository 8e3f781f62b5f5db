"""Words as TESTDATA.md defines them, and hashes of them in numpy."""

from __future__ import annotations

import re

import numpy as np

#: A longest run of letters and digits; used on text in lower case.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
