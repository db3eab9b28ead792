"""CRC-32 of many spans of bytes at once, by tables of positions.

Without its fixed start and end, a CRC is linear: the checksum of a span is the
exclusive or of what each byte contributes, which depends on the byte and on its
distance from the span's end, and of a constant for the length. Contributions of
all bytes at distances below ``REACH`` stand in one table, so the checksums of
all short spans are one gather and one ``bitwise_xor.reduceat``. A longer span is
cut into blocks of ``REACH`` bytes; the state after each block is carried over
the next one, whose own contribution is a reduceat as well.
"""

from __future__ import annotations

import numpy as np

# Fixed value of the checksum: its polynomial, lowest power first.
POLYNOMIAL = 0xEDB88320
ONES = 0xFFFFFFFF
# Distances from a span's end that the table has.
REACH = 64
# Bytes whose contributions are held at once.
BLOCK_BYTES = 1 << 20


def byte_table() -> np.ndarray:
    """What a byte turns into after its eight bits went through the register."""
    entries = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        entries = np.where(entries & 1, (entries >> 1) ^ np.uint32(POLYNOMIAL), entries >> 1).astype(np.uint32)
    return entries


_BYTES = byte_table()


def past_zero(state: np.ndarray) -> np.ndarray:
    """Registers after one more byte of zeros."""
    return (state >> np.uint32(8)) ^ _BYTES[state & np.uint32(0xFF)]


def position_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contributions by distance and byte, constants by length, and the table that
    carries each byte of a register over ``REACH`` bytes."""
    rows = [_BYTES]
    for _ in range(REACH - 1):
        rows.append(past_zero(rows[-1]))
    start, constants = np.array([ONES], dtype=np.uint32), []
    for _ in range(REACH + 1):
        constants.append(int(start[0]) ^ ONES)
        start = past_zero(start)
    carry = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(REACH):
        carry = past_zero(carry)
    return np.concatenate(rows), np.array(constants, dtype=np.uint32), carry


_POSITIONS, _CONSTANTS, _CARRY = position_table()


def contributions(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The exclusive or of the contributions of each span; none is empty or longer than ``REACH``."""
    ends = np.cumsum(lengths)
    begin = ends - lengths
    place = np.arange(int(ends[-1]), dtype=np.int64)
    bytes_ = raw[place + np.repeat(starts - begin, lengths)]
    distance = np.repeat(ends - 1, lengths) - place
    return np.bitwise_xor.reduceat(_POSITIONS[distance * 256 + bytes_], begin)


def long_span(raw: np.ndarray) -> int:
    """The checksum of one span of any length, folded block by block."""
    head = len(raw) % REACH
    state = np.array([ONES], dtype=np.uint32)
    for _ in range(head):
        state = past_zero(state)
    if head:
        state ^= contributions(raw, np.array([0]), np.array([head]))
    for a in range(head, len(raw), BLOCK_BYTES // REACH * REACH):
        b = min(a + BLOCK_BYTES // REACH * REACH, len(raw))
        starts = np.arange(a, b, REACH)
        for own in contributions(raw, starts, np.full(len(starts), REACH)):
            s = state[0]
            state[0] = _CARRY[0, s & 0xFF] ^ _CARRY[1, (s >> 8) & 0xFF] ^ _CARRY[2, (s >> 16) & 0xFF] ^ _CARRY[3, s >> 24] ^ own
    return int(state[0]) ^ ONES


def crc32(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each span ``raw[start : start + length]``, empty ones too.

    Spans may overlap and stand in any order.
    """
    out = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= REACH))
    held = np.cumsum(lengths[short]) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(short)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            some = short[a:b]
            out[some] = contributions(raw, starts[some], lengths[some]) ^ _CONSTANTS[lengths[some]]
    for k in np.flatnonzero(lengths > REACH):
        out[k] = long_span(raw[starts[k] : starts[k] + lengths[k]])
    return out


# The same in DuckDB's SQL; its table comes from its rule as well.
CRC_TABLE = f"""crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END)) AS entries)"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text, null for null, in a query from ``crc_table``."""
    digits = f"hex(encode({text}))"
    digit = f"instr('0123456789ABCDEF', substr({digits}, 2 * p + %s, 1)) - 1"
    data = f"list_transform(range(length({digits}) // 2), lambda p: CAST(16 * ({digit % 1}) + {digit % 2} AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST({ONES} AS BIGINT)], {data}), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), {ONES})"
