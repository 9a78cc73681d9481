"""Geohash keys as column expressions: no UDF, so they stay in generated code and push through joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the base-32 digits.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
MOST_BITS = 60


def axis_bits(precision: int) -> tuple[int, int]:
    """(latitude, longitude) bits of a hash with that many characters; longitude comes first, so it has the odd one."""
    bits = min(5 * max(precision, 1), MOST_BITS)
    return bits // 2, bits - bits // 2


def _cell(value: Column, low: float, width: float, bits: int) -> Column:
    """The cell of [low, low + width) among 2^bits; values outside go to the ends, NaN to the first."""
    value = F.nanvl(value.cast("double"), F.lit(low))
    return F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), F.floor((value - low) / width * float(2**bits)))).cast("bigint")


def _bit(lat: Column, lon: Column, lat_bits: int, lon_bits: int, i: int) -> Column:
    """Bit i of the hash, from its start: longitude and latitude take turns."""
    source, of, at = (lon, lon_bits, i // 2) if i % 2 == 0 else (lat, lat_bits, i // 2)
    return F.shiftright(source, of - 1 - at).bitwiseAND(F.lit(1))


def encode(lat: Column, lon: Column, precision: int = 12) -> Column:
    """The geohash; precisions under 1 count as 1, characters beyond 60 bits are zeros in front."""
    precision = max(precision, 1)
    lat_bits, lon_bits = axis_bits(precision)
    la, lo = _cell(lat, -90.0, 180.0, lat_bits), _cell(lon, -180.0, 360.0, lon_bits)
    digits = []
    for c in range((lat_bits + lon_bits) // 5):
        index = F.lit(0).cast("bigint")
        for k in range(5):
            index = index + F.shiftleft(_bit(la, lo, lat_bits, lon_bits, 5 * c + k), 4 - k)
        digits.append(F.substring(F.lit(ALPHABET), (index + 1).cast("int"), F.lit(1)))
    code = F.concat(*digits)
    return F.lpad(code, precision, "0") if precision > len(digits) else code


def number(code: Column, precision: int) -> Column:
    """The bits of a hash of at most 12 characters as one long; characters outside the alphabet count as 0."""
    value = F.lit(0).cast("bigint")
    for c in range(precision):
        digit = F.greatest(F.instr(F.lit(ALPHABET), F.substring(code, c + 1, 1)) - 1, F.lit(0))
        value = value * 32 + digit
    return value


def alternate_bits(value: Column, bits: int, first: int) -> Column:
    """Every second of `bits` bits from the start on, first = 0 or 1, as one long."""
    out = F.lit(0).cast("bigint")
    for i in range(first, bits, 2):
        out = out * 2 + F.shiftright(value, bits - 1 - i).bitwiseAND(F.lit(1))
    return out


def decode(code: Column, precision: int) -> Column:
    """struct(lat, lon): the centre of the cell, rounded half up to as many decimals as the axis has bits, divided by 5."""
    lat_bits, lon_bits = axis_bits(precision)
    value = number(code, precision)
    center = lambda cell, low, width, bits: F.round(low + (cell + 0.5) * (width / 2**bits), bits // 5)
    lon, lat = alternate_bits(value, 5 * precision, 0), alternate_bits(value, 5 * precision, 1)
    return F.struct(center(lat, -90.0, 180.0, lat_bits).alias("lat"), center(lon, -180.0, 360.0, lon_bits).alias("lon"))


def binary(value: Column, bits: int) -> Column:
    return F.lpad(F.bin(value), bits, "0")


def describe(code: Column, precision: int) -> Column:
    """'lat lon bits binary' of a hash."""
    point = decode(code, precision)
    return F.format_string("%.6f %.6f %d %s", point["lat"], point["lon"], F.lit(5 * precision), binary(number(code, precision), 5 * precision))
