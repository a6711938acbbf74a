"""Column expressions."""

from .addresses import ip_to_text, text_to_ip
from .keys import flow_key, group_key, joined_identity
from .numbers import micros_between, one_decimal, one_decimal_text, round_half_up, signed_zero
from .once import with_once
from .packets import direction, flag_count, flags_text, has_flag, protocol_name, short_direction

__all__ = [
    "direction",
    "flag_count",
    "flags_text",
    "flow_key",
    "group_key",
    "has_flag",
    "ip_to_text",
    "joined_identity",
    "micros_between",
    "one_decimal",
    "one_decimal_text",
    "protocol_name",
    "round_half_up",
    "short_direction",
    "signed_zero",
    "text_to_ip",
    "with_once",
]
