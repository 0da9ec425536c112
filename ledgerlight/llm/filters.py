"""Bitmaps of key hashes, of bounded size: what a scan asks before it sends a row anywhere.

Every key that was put in passes; others pass by chance, and are dropped by the join that follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ledgerlight.operators.bitmaps import bits_for, flagged, pieces_of  # noqa: F401


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits, one for each value of the leading bits of a hash that ``column`` holds; 32 MB at most."""
    bits = bits_for(hashes, column)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in pieces_of(hashes, column, bits).collect():
        held = np.frombuffer(row["held"], np.uint8)
        begin = (row["piece"] - 1) * len(held)
        out[begin:begin + len(held)] = held[:max(0, len(out) - begin)]
    return out


def passes(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes the bitmap holds."""
    slots = prints >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
