"""Vector clocks as MAP<STRING, BIGINT>; a node that is missing counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "map<string,bigint>"


def _clean(c: Column) -> Column:
    return F.coalesce(c, F.create_map().cast(EMPTY))


def exceeds(a: Column, b: Column) -> Column:
    """Whether some node's counter in a is above that in b."""
    a, b = _clean(a), _clean(b)
    return F.exists(F.map_entries(a), lambda e: e["value"] > F.coalesce(F.element_at(b, e["key"]), F.lit(0)))


def compare(a: Column, b: Column) -> Column:
    """Equal, Before, After or Concurrent."""
    up, down = exceeds(a, b), exceeds(b, a)
    return F.when(up & down, "Concurrent").when(up, "After").when(down, "Before").otherwise("Equal")


def merge(a: Column, b: Column) -> Column:
    """The greater counter of each node."""
    return F.map_zip_with(_clean(a), _clean(b), lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0).cast("bigint")), F.coalesce(y, F.lit(0).cast("bigint"))))


def increment(c: Column, node: Column) -> Column:
    c = _clean(c)
    rest = F.map_filter(c, lambda k, v: k != node)
    return F.map_concat(rest, F.create_map(node, F.coalesce(F.element_at(c, node), F.lit(0).cast("bigint")) + 1))


def canonical(c: Column) -> Column:
    """Text that is equal for equal clocks: entries in order of nodes, without zeros."""
    entries = F.array_sort(F.map_entries(F.map_filter(_clean(c), lambda k, v: v > 0)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
