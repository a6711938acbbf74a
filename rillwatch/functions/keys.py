"""Keys of flows and of groups of flows."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FIVE_TUPLE, GLOBAL_KEY, MISSING_KEY


def _text(name: str) -> Column:
    # a missing part is written as the word null
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def flow_key() -> Column:
    """Readable key ``src:port-dst:port-PROTOCOL``."""
    colon, dash = F.lit(":"), F.lit("-")
    source = (_text("src_ip"), colon, _text("src_port"))
    target = (_text("dst_ip"), colon, _text("dst_port"))
    return F.concat(*source, dash, *target, dash, _text("protocol"))


def joined_identity() -> Column:
    """The five parts written one after the other; different flows can share this text."""
    return F.concat(*[_text(name) for name in FIVE_TUPLE])


def group_key(group_cols: Sequence[str] = ()) -> Column:
    """One non-NULL text per group: a constant, the column's text, or JSON for several columns."""
    if not group_cols:
        return F.lit(GLOBAL_KEY)
    if len(group_cols) == 1:
        return F.coalesce(F.col(group_cols[0]).cast("string"), F.lit(MISSING_KEY))
    return F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"})
