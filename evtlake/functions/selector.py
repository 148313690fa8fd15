"""Selectors of event and function names: keccak-256 of the name, cut to 250 bits."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK64 = (1 << 64) - 1


@lru_cache(maxsize=1)
def _constants() -> tuple[list[int], dict[tuple[int, int], int]]:
    """Round constants from their shift register, rotations from their walk over the lanes."""
    bits, state = [], 1
    for _ in range(255):
        bits.append(state & 1)
        state = (state << 1) ^ (0x171 if state & 0x80 else 0)
    rounds = [sum(bits[(7 * r + j) % 255] << ((1 << j) - 1) for j in range(7)) for r in range(24)]
    turns, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        turns[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turns


def _rotate(v: int, n: int) -> int:
    return (v << n | v >> (64 - n)) & _MASK64 if n else v


def keccak256(data: bytes) -> bytes:
    """The original padding (first byte 1), not that of SHA-3."""
    rate = 136
    padded = bytearray(data) + bytes(rate - len(data) % rate)
    padded[len(data)] |= 1
    padded[-1] |= 0x80
    rounds, turns = _constants()
    lanes = {(x, y): 0 for x in range(5) for y in range(5)}
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            lanes[i % 5, i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        for constant in rounds:
            parity = [lanes[x, 0] ^ lanes[x, 1] ^ lanes[x, 2] ^ lanes[x, 3] ^ lanes[x, 4] for x in range(5)]
            mixed = {(x, y): v ^ parity[x - 1] ^ _rotate(parity[(x + 1) % 5], 1) for (x, y), v in lanes.items()}
            moved = {(y, (2 * x + 3 * y) % 5): _rotate(v, turns[x, y]) for (x, y), v in mixed.items()}
            lanes = {(x, y): v ^ (~moved[(x + 1) % 5, y] & moved[(x + 2) % 5, y] & _MASK64) for (x, y), v in moved.items()}
            lanes[0, 0] ^= constant
    return b"".join(lanes[i, 0].to_bytes(8, "little") for i in range(4))


def selector(name: str) -> str:
    return hex(int.from_bytes(keccak256(name.encode()), "big") & ((1 << 250) - 1))


def selector_column(name: Column) -> Column:
    """For the few distinct names of a catalog."""

    @F.pandas_udf("string")
    def of(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else selector(n))

    return of(name)
