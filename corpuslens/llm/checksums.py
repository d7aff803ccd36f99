"""CRC-32C of many byte strings at once, and the masking that record files use."""

from __future__ import annotations

from functools import cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # fixed value: Castagnoli, reflected
MASK_DELTA = 0xA282EAD8  # fixed value of the record format
BLOCK = 64


@cache
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


@cache
def _block_tables() -> np.ndarray:
    """Row j: what byte j of a block adds to the block's remainder."""
    rows = [_byte_table()]
    for _ in range(BLOCK - 1):
        rows.append(_byte_table()[rows[-1] & 0xFF] ^ (rows[-1] >> 8))
    return np.array(rows[::-1])


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 0xFF] ^ tables[1][(x >> 8) & 0xFF] ^ tables[2][(x >> 16) & 0xFF] ^ tables[3][x >> 24]


@cache
def _shift(power: int) -> np.ndarray:
    """Tables of the linear map "append 2 ** power zero bytes"."""
    if power == 0:
        each = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
        return np.array([_byte_table()[x & 0xFF] ^ (x >> 8) for x in each])
    half = _shift(power - 1)
    return np.array([_apply(half, row) for row in half])


def crc32c(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of byte strings of the given lengths that stand one after the other in ``data``."""
    lengths = np.asarray(lengths, np.int64)
    counts = np.maximum(-(-lengths // BLOCK), 1)
    padded = np.zeros(int(counts.sum()) * BLOCK, np.uint8)  # zeros in front change nothing
    ends = np.cumsum(counts) * BLOCK
    target = np.repeat(ends - np.cumsum(lengths), lengths) + np.arange(int(lengths.sum()))
    padded[target] = data
    columns = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
    value = np.zeros(columns.shape[1], np.uint32)
    for table, column in zip(_block_tables(), columns, strict=True):
        value ^= table[column]
    power = BLOCK.bit_length() - 1
    while counts.max(initial=1) > 1:
        odd = np.flatnonzero(counts % 2)
        starts = np.append(0, np.cumsum(counts)[:-1])
        value = np.insert(value, starts[odd], np.uint32(0)).reshape(-1, 2)
        value = _apply(_shift(power), value[:, 0]) ^ value[:, 1]
        counts = (counts + 1) // 2
        power += 1
    ones = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        bit = (lengths >> k) & 1 == 1
        ones[bit] = _apply(_shift(k), ones[bit])
    return value ^ ones ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
