"""Column expressions on packet fields: direction, protocol and TCP flags."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: IP protocol numbers and TCP header flag bits
TCP = 6
UDP = 17
FIN = 0x01
SYN = 0x02
RST = 0x04
PSH = 0x08
ACK = 0x10
URG = 0x20
# order in which the flags of a packet are listed
FLAG_NAMES = ((SYN, "SYN"), (ACK, "ACK"), (FIN, "FIN"), (RST, "RST"), (PSH, "PSH"), (URG, "URG"))
# abbreviations used in the flow report
SHORT_DIRECTIONS = (("OUTBOUND", "OUT"), ("INBOUND", "IN"), ("LATERAL", "LAT"))


def direction(src: Column, dst: Column, net: int, mask: int) -> Column:
    """Direction of a packet relative to the local network ``net``/``mask``."""
    if mask == 0:
        return F.lit("UNKNOWN")
    src_local = src.bitwiseAND(F.lit(mask)) == F.lit(net)
    dst_local = dst.bitwiseAND(F.lit(mask)) == F.lit(net)
    return (
        F.when(src_local & dst_local, "LATERAL")
        .when(src_local, "OUTBOUND")
        .when(dst_local, "INBOUND")
        .otherwise("UNKNOWN")
    )


def short_direction(name: Column) -> Column:
    short = F
    for long_name, abbreviation in SHORT_DIRECTIONS:
        short = short.when(name == long_name, abbreviation)
    return short.otherwise("UNK")


def protocol_name(number: Column) -> Column:
    return F.when(number == TCP, "TCP").when(number == UDP, "UDP").otherwise("OTHER")


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def flag_count(protocol: Column, flags: Column, bit: int) -> Column:
    """Aggregate: TCP packets with the flag set."""
    return F.count_if((protocol == TCP) & has_flag(flags, bit))


def flags_text(protocol: Column, flags: Column) -> Column:
    """Names of the set flags separated by spaces; empty when none is set, NULL unless TCP."""
    names = [F.when(has_flag(flags, bit), name) for bit, name in FLAG_NAMES]
    return F.when(protocol == TCP, F.concat_ws(" ", *names))
