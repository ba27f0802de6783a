"""Left lookup joins that hold up under hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 64
SALTS = 16


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    right_bytes: int | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """``left`` with the columns of ``right`` for the same key, null if there is none.

    With a known size of ``right`` the join is a broadcast up to a fixed limit,
    and beyond it a salted shuffle join: each key of the left side is spread over
    ``SALTS`` tasks by the hash of ``spread_by``, and the right side is repeated
    once per salt (unless there is nothing to spread by), so that one key holding a third of the rows is split too. The
    salt depends only on the row, so a repeated task sends it the same way; copies
    of one row share a salt, and what is left of such a group is split by adaptive
    execution, which divides large sort-merge partitions by their map outputs.
    Without a known size adaptive execution chooses from the sizes it measures.
    """
    if right_bytes is None:
        return left.join(right, key, "left")
    if right_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, "left")
    if not spread_by:  # one left row for each key: nothing to spread
        return left.join(right.hint("merge"), key, "left")
    salts = F.array(*[F.lit(salt) for salt in range(SALTS)])
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(salts))
    return salted.join(repeated.hint("merge"), [key, "_salt"], "left").drop("_salt")
