"""Duration texts such as ``10 seconds``."""

import re

# fixed values: units of a tumbling window in microseconds
_UNITS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def micros(duration: str) -> int:
    """Length of a duration written as number and unit, one or more times."""
    parts = re.findall(r"(\d+)\s*([a-z]+?)s?\b", duration.lower())
    if not parts or any(unit not in _UNITS for _, unit in parts):
        raise ValueError(f"not a fixed duration: {duration!r}")
    return sum(int(number) * _UNITS[unit] for number, unit in parts)
