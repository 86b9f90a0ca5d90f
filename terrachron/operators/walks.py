"""Ranking the members of linked lists and cycles by pointer doubling: as many rounds as the longest one's length has binary digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.sources.shared import counted, settled


def walks(links: DataFrame) -> DataFrame:
    """links (id, next: null at the end of a list), each id once and next to at most one id, to (id, cyclic, head, offset).

    In a list, head is its last member and offset the number of steps to it. In a cycle, head is the least id and offset the
    number of steps to it, going forward. A next that isn't an id ends its list. Ids are numbers; rows without one are left out.
    """
    rows = links.where("id is not null").select("id", "next")
    known = rows.select(F.col("id").alias("next"), F.lit(True).alias("_known"))
    started = rows.where("next is not null").join(known, "next", "left").select("id", F.when(F.col("_known"), F.col("next")).alias("jump"))
    started = started.union(rows.where("next is null").select("id", F.lit(None).cast("long")))
    now = settled(started.select("id", "jump", F.lit(1).cast("long").alias("n"), F.col("id").alias("last"), F.col("id").alias("least"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("moved")))
    while True:
        # Of the stretch from an id on: where it goes on, how many it has, its last, its least, and how far off that is.
        ahead = now.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("n").alias("n2"), F.col("last").alias("last2"), F.col("least").alias("least2"), F.col("at").alias("at2"))
        less = F.col("least2") < F.col("least")
        joined = now.where("jump is not null").join(ahead, "jump").select(
            "id", F.col("jump2").alias("jump"), (F.col("n") + F.col("n2")).alias("n"), F.col("last2").alias("last"), F.least("least", "least2").alias("least"),
            F.when(less, F.col("n") + F.col("at2")).otherwise(F.col("at")).alias("at"), (less | F.col("jump2").isNull()).alias("moved"),
        )
        now, moved = counted(now.where("jump is null").withColumn("moved", F.lit(False)).unionByName(joined), F.col("moved"))
        if not moved:
            break
    cyclic = F.col("jump").isNotNull()
    return now.select("id", cyclic.alias("cyclic"), F.when(cyclic, F.col("least")).otherwise(F.col("last")).alias("head"), F.when(cyclic, F.col("at")).otherwise(F.col("n") - 1).alias("offset"))


def in_order(size: Column, offset: Column, cyclic: Column) -> Column:
    """The place of a member from 0: a list begins with what is furthest from its last member, a cycle with its least."""
    return F.when(cyclic & (offset > 0), size - offset).when(cyclic, F.lit(0).cast("long")).otherwise(size - 1 - offset)
