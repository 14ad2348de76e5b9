"""Serial frames of the galvo controller, given as compact upper-case hex text.

A frame is ``55 AA 01 opcode payload checksum``; payload numbers are little-endian
32-bit; the checksum is the low byte of the sum of all bytes before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the protocol.
HEADER = "55AA01"
STEP_ANGLE, FORWARD_SPEED, REVERSE_SPEED = 0x11, 0x0B, 0x0D
SYNC_MODE, VOLTAGE = 0x03, 0x1D
PAIR_GETTERS = [0x0B, 0x0D, 0x11]
SINGLE_GETTERS = [0x03, 0x0F, 0x17, 0x19, 0x1D]
GETTER_OF_SETTER = {
    0x02: 0x03, 0x0A: 0x0B, 0x0C: 0x0D, 0x0E: 0x0F, 0x10: 0x11, 0x16: 0x17, 0x18: 0x19, 0x1C: 0x1D,
}


def n_bytes(frame: Column) -> Column:
    return F.floor(F.length(frame) / 2).cast("int")


def byte_at(frame: Column, index: int) -> Column:
    return F.conv(F.substring(frame, 2 * index + 1, 2), 16, 10).cast("bigint")


def byte_sum(frame: Column) -> Column:
    """Sum of all bytes but the last."""
    last = n_bytes(frame) - 1
    return F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), last - 1)), F.lit(0).cast("bigint"),
        lambda total, i: total + F.conv(F.substring(frame, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))


def checksum_ok(frame: Column) -> Column:
    size = n_bytes(frame)
    last = F.conv(F.substring(frame, size * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
    return F.when(size < 5, F.lit(False)).otherwise(F.pmod(byte_sum(frame), F.lit(256)) == last)


def has_header(frame: Column) -> Column:
    return (F.substring(frame, 1, 6) == HEADER) & (n_bytes(frame) >= 4)


def opcode(frame: Column) -> Column:
    return F.when(has_header(frame), byte_at(frame, 3))


def uint32(frame: Column, start: int) -> Column:
    total = byte_at(frame, start)
    for i in range(1, 4):
        total = total + byte_at(frame, start + i) * (1 << (8 * i))
    return total


def expected_size(code: Column) -> Column:
    """Answer length of a query opcode; 0 for opcodes that are no queries."""
    return F.when(code.isin(PAIR_GETTERS), 13).when(code.isin(SINGLE_GETTERS), 9).otherwise(0)


def decode(frame: Column) -> Column:
    """Struct ``(opcode, first, second, value)`` of an answer; NULL where header, length or
    checksum do not fit. ``value`` is in degrees, milliseconds, volts or as sent."""
    code = opcode(frame)
    size = expected_size(code)
    first = uint32(frame, 4)
    pair = code.isin(PAIR_GETTERS)
    second = F.when(pair, uint32(frame, 8))
    value = (
        F.when(code == STEP_ANGLE, first * second / 100.0)
        .when(pair, (first * second).cast("double"))
        .when(code == VOLTAGE, first / 10.0)
        .when(code == SYNC_MODE, F.when(first == 0, 0.0).otherwise(1.0))
        .otherwise(first.cast("double")))
    good = has_header(frame) & (size > 0) & (n_bytes(frame) >= size) & checksum_ok(
        F.substring(frame, F.lit(1), size * 2))
    return F.when(good, F.struct(
        code.alias("opcode"), first.alias("first"), second.alias("second"), value.alias("value")))
