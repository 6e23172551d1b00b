"""Order-sensitive scans that do not put a whole document into one task.

A window over a document puts all of its rows into one partition, which fails when one document holds a
large share of the corpus. Here rows are cut into blocks of consecutive positions. Each block is reduced to
one summary row, the summaries are scanned per document, and a window inside each block adds the rest. The
work per task is bounded by the block, and the summaries are smaller than the rows by the block size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.config import DEFAULTS
from cartulary.session import settle

_BLOCK = "__block"


@dataclass(frozen=True)
class Carry:
    """One running value: ``last`` non-null value, ``max``, ``min`` or ``sum`` of ``value`` seen so far."""

    name: str
    value: Column
    how: str


def _summary(carry: Carry, index: str, reverse: bool) -> Column:
    if carry.how == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(carry.value, F.when(carry.value.isNotNull(), F.col(index)))
    return {"max": F.max, "min": F.min, "sum": F.sum}[carry.how](carry.value)


def _over(carry: Carry, value: Column, window) -> Column:
    if carry.how == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"max": F.max, "min": F.min, "sum": F.sum}[carry.how](value).over(window)


def _combine(carry: Carry, before: Column, inside: Column) -> Column:
    if carry.how == "last":
        return F.coalesce(inside, before)
    if carry.how == "max":
        return F.greatest(before, inside)
    if carry.how == "min":
        return F.least(before, inside)
    return F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))


def running(
    frame: DataFrame,
    key: list[str],
    index: str,
    carries: list[Carry],
    *,
    reverse: bool = False,
    inclusive: bool = False,
    block_rows: int = DEFAULTS.block_rows,
) -> DataFrame:
    """Add one column per carry with its value over the earlier rows (later rows if ``reverse``).

    ``index`` is a unique, non-negative whole number per key. Gaps are fine.
    """
    blocked = frame.withColumn(_BLOCK, F.floor(F.col(index) / F.lit(block_rows)))
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    keys = [*key, _BLOCK]

    summary = blocked.groupBy(*keys).agg(*[_summary(c, index, reverse).alias(f"__s_{c.name}") for c in carries])
    across = Window.partitionBy(*key).orderBy(direction(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    entering = summary.select(
        *keys, *[_over(c, F.col(f"__s_{c.name}"), across).alias(f"__in_{c.name}") for c in carries]
    )

    within = (
        Window.partitionBy(*keys)
        .orderBy(direction(index))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = blocked.select("*", *[_over(c, c.value, within).alias(f"__at_{c.name}") for c in carries])
    joined = local.join(entering, keys, "left")
    result = joined.select(
        *[F.col(c) for c in frame.columns],
        *[_combine(c, F.col(f"__in_{c.name}"), F.col(f"__at_{c.name}")).alias(c.name) for c in carries],
    )
    return result


def neighbour(
    frame: DataFrame, key: list[str], index: str, value: Column, name: str, *, following: bool = False
) -> DataFrame:
    """``lag``/``lead`` by one row. ``value`` may be null; it is boxed so that nulls carry too."""
    box = Carry("__box", F.struct(value.alias("v")), "last")
    boxed = running(frame, key, index, [box], reverse=following)
    return boxed.select(*[F.col(c) for c in frame.columns], F.col("__box.v").alias(name))


def composed(
    frame: DataFrame,
    key: list[str],
    index: str,
    effect: Column,
    name: str,
    compose: Callable[[Column, Column], Column],
    identity: Column,
    *,
    reverse: bool = False,
    block_rows: int = DEFAULTS.block_rows,
    fan: int = 256,
) -> DataFrame:
    """Add ``name``: the composition of ``effect`` over the earlier rows of a key, in the order of ``index``.

    With ``reverse`` it is that of the later rows, the last one first.

    ``compose(first, then)`` is any associative operation, ``identity`` its neutral value. Rows are taken together
    ``fan`` at a time: a group of ``fan`` neighbours becomes a row with all its prefixes, whose last is one row of the
    next level, until a level holds one group a key. So no row ever holds more than ``fan`` values, and the number of
    levels grows with the logarithm of the longest key.
    """
    numbered = settle(running(frame, key, index, [Carry(_NUMBER, F.lit(1).cast("long"), "sum")], reverse=reverse, block_rows=block_rows))
    values = numbered.select(*key, F.col(_NUMBER), effect.alias("__effect"))
    last = values.agg(F.max(_NUMBER)).first()[0]
    before = _before(values, key, 0 if last is None else last, compose, identity, fan)
    return numbered.join(before, [*key, _NUMBER]).select(*frame.columns, F.col("__before").alias(name))


_NUMBER = "__number"


def _before(values: DataFrame, key: list[str], last: int, compose, identity: Column, fan: int) -> DataFrame:
    """``(*key, __number, __before)`` for values numbered from 0 to at most ``last`` in every key."""
    grouped = values.groupBy(*key, F.floor(F.col(_NUMBER) / F.lit(fan)).alias(_BLOCK)).agg(
        F.sort_array(F.collect_list(F.struct(_NUMBER, "__effect"))).alias("__items")
    )
    scanned = grouped.select(*key, _BLOCK, F.transform("__items", lambda x: x["__effect"]).alias("__upto"))
    reach = 1
    while reach < min(fan, last + 1):  # each prefix takes in as many values again as it holds
        scanned = scanned.withColumn("__upto", _doubled(reach, compose))
        reach *= 2
    if last < fan:
        entered = scanned.withColumn("__entering", identity)
    else:
        scanned = settle(scanned)
        totals = scanned.select(*key, F.col(_BLOCK).alias(_NUMBER), F.element_at("__upto", -1).alias("__effect"))
        above = _before(totals, key, last // fan, compose, identity, fan)
        entered = scanned.join(above.select(*key, F.col(_NUMBER).alias(_BLOCK), F.col("__before").alias("__entering")), [*key, _BLOCK])
    exclusive = F.concat(F.array(identity), F.slice("__upto", F.lit(1), F.size("__upto") - 1))
    spread = entered.select(*key, _BLOCK, "__entering", F.posexplode(exclusive).alias("__at", "__inside"))
    return spread.select(
        *key,
        (F.col(_BLOCK) * fan + F.col("__at")).alias(_NUMBER),
        compose(F.col("__entering"), F.col("__inside")).alias("__before"),
    )


def _doubled(reach: int, compose) -> Column:
    return F.transform(
        "__upto", lambda x, i: F.when(i >= reach, compose(F.get("__upto", i - reach), x)).otherwise(x)
    )
