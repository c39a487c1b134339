"""Anti-entropy: compare trees, fetch the other side's differing buckets, and reconcile their versions in; round after round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkv.functions import clocks
from loomkv.operators import merkle
from loomkv.operators import versions as V

#: What a fetched version's place in the order of arrival is raised by: the own ones came first.
LATER = 1 << 60


def entries(held: DataFrame) -> DataFrame:
    """key, blob of sibling sets (key, clock, deleted, value): the set's text, the same for equal sets in any order."""
    one = F.concat_ws("|", clocks.canonical(F.col("clock")), F.col("deleted").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit("")))
    return held.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("blob"))


def pull(mine: DataFrame, theirs: DataFrame, leaves: int = 1024) -> DataFrame:
    """This side's sibling sets (key, seq, clock, deleted, value, ...) after the round: fetched versions are reconciled in, so concurrent ones become siblings.

    Trees are aggregated before they are moved; of the other side only entries of differing buckets are.
    """
    buckets = merkle.diff(merkle.leaves(entries(mine), leaves), merkle.leaves(entries(theirs), leaves))
    fetched = merkle.fetch(theirs, buckets, leaves).drop("bucket").withColumn("seq", F.col("seq") + LATER)
    return V.reconcile(mine.unionByName(fetched), "key").withColumn("seq", F.col("seq") % LATER)


def rounds(held: dict[str, DataFrame], visits: list[tuple[str, str]], keep: Callable[[DataFrame], DataFrame], leaves: int = 1024) -> dict[str, DataFrame]:
    """The loop: visits (who pulls, from whom) one after the other; each sees what those before it did. keep writes a round's table and reads it back."""
    held = dict(held)
    for me, peer in visits:
        held[me] = keep(pull(held[me], held[peer], leaves))
    return held
