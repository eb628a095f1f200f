"""Broadcast only behind a proven row bound.

A side is broadcast when a bound on its row count is known and within the
budget: either it is a subset of a table whose size was counted (the
catalog), or it has a bound by construction (one row per partition).
Beyond the budget the plain join is kept, so the planner shuffles (and
adaptive execution may still broadcast if the runtime size is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed budget: rows of a catalog-sized side we are willing to ship to every
# executor (ids plus a name: ~100 MB at the limit).
BROADCAST_ROWS = 1_000_000

# Rows of one key above which a line-item join handles the key map-side
# (``hot_key_join``): about 160 MB of (order, product) pairs for one reducer.
HOT_ROWS = 10_000_000


def bounded_broadcast(df: DataFrame, row_bound: int, budget: int | None = None) -> DataFrame:
    """``broadcast(df)`` if ``df`` is known to hold at most ``row_bound``
    rows and that is within ``budget`` (default ``BROADCAST_ROWS``);
    otherwise ``df`` unchanged, and the planner shuffles."""
    return F.broadcast(df) if row_bound <= (BROADCAST_ROWS if budget is None else budget) else df


def hot_limit(big_rows: int, hot_rows: int) -> int:
    """Rows from which a key is hot: ``hot_rows``, raised with the input so
    that the number of hot keys never passes the broadcast budget."""
    return max(hot_rows, -(-big_rows // max(BROADCAST_ROWS, 1)))


def hot_key_join(
    big: DataFrame,
    small: DataFrame,
    key: str | list[str],
    how: str,
    big_rows: int,
    hot_rows: int,
    sort_merge: bool = False,
) -> DataFrame:
    """``big.join(small, key, how)`` (inner, left or left_anti) without any
    reducer receiving a hot key of ``big``. ``small`` holds at most one row
    per key (a primary-key side, like orders), which is what bounds its
    broadcast part below.

    A key holding ``hot_rows`` rows or more of ``big`` is hot (more on very
    large inputs: ``hot_limit``); there are at most ``big_rows`` divided by
    that many of them, the proven bound under which the
    hot keys (and ``small``'s rows for them) are broadcast. Hot rows of
    ``big`` are joined map-side against that broadcast; the other rows are
    removed from the hot keys map-side first and take the ordinary
    (shuffled) join. With a zero bound no key can be hot and the plain join
    is returned. ``sort_merge`` pins the ordinary join to a sort-merge join
    (for two sides that are both large at scale, when a small-data plan
    would broadcast the bigger one into a few tasks)."""
    keys = [key] if isinstance(key, str) else list(key)
    hot_rows = hot_limit(big_rows, hot_rows)
    bound = big_rows // hot_rows
    ordinary_small = small.hint("merge") if sort_merge else small
    if bound == 0:
        return big.join(ordinary_small, keys, how)
    hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= hot_rows).select(*keys)
    hot_ids = bounded_broadcast(hot, bound)
    hot_small = small.join(hot_ids, keys)
    if how == "left_anti":
        hot_small = hot_small.select(*keys).distinct()
    hot_small = bounded_broadcast(hot_small, bound)
    hot_part = big.join(hot_ids, keys, "left_semi").join(hot_small, keys, how)
    ordinary = big.join(hot_ids, keys, "left_anti").join(ordinary_small, keys, how)
    return hot_part.unionByName(ordinary)


# Rows of one key that a salted join leaves to one task, and the most parts a
# key is cut into (the other side is repeated as often).
SALT_ROWS = 4_000_000
MAX_SALTS = 64


def salts_for(big: DataFrame, key: str, salt_rows: int | None = None) -> int:
    """Parts that keep ``big``'s largest key at about ``salt_rows`` a task."""
    salt_rows = SALT_ROWS if salt_rows is None else salt_rows
    most = big.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    return max(1, min(MAX_SALTS, -(-most // salt_rows)))


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int) -> DataFrame:
    """``big.join(small, key)`` with each key cut into ``salts`` parts: rows of
    ``big`` are dealt by a hash of all their values, those of ``small`` are
    repeated for every part. No reducer gets more than about a ``salts``-th of a
    hot key's rows."""
    if salts <= 1:
        return big.join(small, key)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    every = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(every, [key, "_salt"]).drop("_salt")


def catalog_join(big: DataFrame, small: DataFrame, key: str, row_bound: int, salt_rows: int | None = None) -> DataFrame:
    """``big.join(small, key)`` where ``small`` has at most ``row_bound`` rows,
    one a key: broadcast within the budget, salted by ``big``'s largest key
    beyond it."""
    if row_bound <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key)
    return salted_join(big, small, key, salts_for(big, key, salt_rows))
