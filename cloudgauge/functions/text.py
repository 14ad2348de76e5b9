"""Text functions: file and time names, log escaping, hex text, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name formats and labels.
STAMP = "yyyyMMdd_HHmmss_SSS"
SESSION_PATTERN = r"^(?:reconstruction_capture_)?(\d{8}_\d{6}_\d{3}(?:_[A-Za-z0-9]+)?)$"
LEVELS = ["Debug", "Info", "Warning", "Error"]
CAMERA_STATES = ["Disconnected", "Connected", "Streaming", "Error"]
SYNC_MODES = ["Async", "Sync"]
DIRECTIONS = ["Forward", "Reverse"]


def frame_file_name(index: Column) -> Column:
    """File name of the zero-based frame ``index``; names count from 1."""
    return F.format_string("frame_%06d.bmp", (index + 1).cast("bigint"))


def frame_index(name: Column) -> Column:
    """Inverse of ``frame_file_name``; NULL for other names."""
    digits = F.regexp_extract(name, r"^frame_(\d{6,})\.bmp$", 1)
    return F.when(digits != "", digits.cast("bigint") - 1)


def stamp_name(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def parse_stamp(name: Column) -> Column:
    return F.try_to_timestamp(name, F.lit(STAMP))


def last_part(path: Column) -> Column:
    """Name after the last slash; a slash at the end does not count."""
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def session_key(path: Column, fallback: Column) -> Column:
    """Time stamp in a capture directory's name, else the name of the fallback time."""
    found = F.regexp_extract(last_part(path), SESSION_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), stamp_name(fallback))


def escape_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def unescape_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\r"), F.lit("\r")), F.lit("\\n"), F.lit("\n"))


def display_line(text: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def spaced_hex(payload: Column) -> Column:
    """Bytes as upper-case hex pairs with blanks between."""
    return F.trim(F.regexp_replace(F.hex(payload), "(..)", "$1 "))


def hex_tokens(text: Column) -> Column:
    """Byte texts of hex input with blanks, commas, semicolons, ``0x`` or no gaps at all."""
    parts = F.filter(F.split(F.regexp_replace(text, "[,;]", " "), r"\s+"), lambda t: t != "")
    compact = F.regexp_replace(F.try_element_at(parts, F.lit(1)), "^0[xX]", "")
    length = F.length(compact)
    packed = (F.size(parts) == 1) & (length > 2) & (length % 2 == 0)
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(length / 2).cast("int") - 1)),
        lambda i: F.substring(compact, i * 2 + 1, F.lit(2)))
    return F.when(packed, pairs).otherwise(F.transform(parts, lambda t: F.regexp_replace(t, "^0[xX]", "")))


def parse_hex(text: Column) -> Column:
    """Bytes of hex text; NULL when a token is not two hex digits or there is none."""
    tokens = hex_tokens(text)
    good = (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike("^[0-9A-Fa-f]{2}$"))
    return F.when(good, F.unhex(F.array_join(tokens, "")))


def label(code: Column, names: list[str], unknown: str = "Unknown") -> Column:
    """Text of an enum code counting from 0."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(n) for n in names]), (code + 1).cast("int")), F.lit(unknown))


def label_code(name: Column, names: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(at > 0, at - 1)


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", value)
