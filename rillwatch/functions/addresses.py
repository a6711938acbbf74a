"""IPv4 addresses as unsigned integers and as dotted text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: dotted decimal, four octets of 0..255 without leading zeros
DOTTED = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


def ip_to_text(address: Column) -> Column:
    """``10.42.1.77`` for 170525005."""
    octets = [F.shiftright(address, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8)]
    last = address.bitwiseAND(F.lit(255)).cast("string")
    dot = F.lit(".")
    return F.concat(octets[0], dot, octets[1], dot, octets[2], dot, last)


def text_to_ip(text: Column) -> Column:
    """Inverse of :func:`ip_to_text`; NULL for text that is no IPv4 address."""
    octets = F.split(text, r"\.")
    value = F.lit(0).cast("bigint")
    for position in range(4):
        value = value * 256 + F.get(octets, F.lit(position)).try_cast("bigint")
    return F.when(text.rlike(DOTTED), value)
