"""Parent-pointer forests by pointer doubling: each round, a node looks as far again as it has already seen.

The rounds are logarithmic in the depth, and a round moves a few numbers for each node. Cycles and missing parents are
states, not errors. Ids are unique and not null; rows without id are left out (`quality.duplicates` finds repeated ones).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from terrachron.sources.shared import settled, spread


def roots(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id) to (id, root_id, steps, state): Valid, Missing (a parent isn't a node) or Cycle.

    The root of a Missing line is the id that isn't there. A node in a cycle, or below one, has no root and no steps.
    A line that isn't at its end after as many steps as there are nodes goes round.
    """
    nodes = nodes.where("id is not null").select("id", "parent_id")
    absent = nodes.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().join(spread(nodes.select("id")), "id", "left_anti")
    start = nodes.select("id", F.coalesce("parent_id", "id").alias("top"), F.col("parent_id").isNotNull().cast("long").alias("steps"), F.lit(False).alias("missing"), F.lit(True).alias("there"))
    now = settled(start.unionByName(absent.select("id", F.col("id").alias("top"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("missing"), F.lit(False).alias("there"))))
    n = now.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        above = now.select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"), F.col("missing").alias("_missing"))
        now = settled(now.join(spread(above), "top").select("id", F.col("_top").alias("top"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_missing").alias("missing"), "there", (F.col("_steps") > 0).alias("_open")))
        still = now.where("_open").take(1)
        now = now.drop("_open")
        if not still:
            break
    cycle = F.col("steps") > n
    state = F.when(cycle, "Cycle").when(F.col("missing"), "Missing").otherwise("Valid")
    return now.where("there").select("id", F.when(~cycle, F.col("top")).alias("root_id"), F.when(~cycle, F.col("steps")).alias("steps"), state.alias("state"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id) to (id, ancestors, root_id, state): the ids above a node, nearest first; null for Cycle.

    The lines together are as long as the sum of all depths. Where only the root or the depth is asked for, `roots` does.
    """
    ends = settled(roots(nodes))
    nodes = nodes.where("id is not null").select("id", "parent_id")
    none = F.array().cast(f"array<{nodes.schema['id'].dataType.simpleString()}>")
    sound = nodes.join(spread(ends.where("state <> 'Cycle'").select("id")), "id", "left_semi")
    lines = settled(sound.select("id", F.when(F.col("parent_id").isNotNull(), F.array("parent_id")).otherwise(none).alias("line")))
    seen = 1
    while lines.where(F.size("line") == seen).take(1):
        above = lines.select(F.col("id").alias("_top"), F.col("line").alias("_more"))
        lines = settled(lines.join(spread(above), F.try_element_at("line", F.lit(-1)) == F.col("_top"), "left").select("id", F.concat("line", F.coalesce("_more", none)).alias("line")))
        seen *= 2
    return ends.join(spread(lines), "id", "left").select("id", F.col("line").alias("ancestors"), "root_id", "state")


def descendants(nodes: DataFrame, root) -> DataFrame:
    """All ids below one, with their depth. The node is cut off from what is above it, so it is the root of all below."""
    cut = nodes.select("id", F.when(F.col("id") != F.lit(root), F.col("parent_id")).alias("parent_id"))
    return roots(cut).where((F.col("root_id") == F.lit(root)) & (F.col("id") != F.lit(root))).select("id", F.col("steps").cast("int").alias("depth"))


#: A family is dealt in shares of so many, each of which meets the whole family in a task.
SHARE = 1_000


def siblings(nodes: DataFrame, share: int = SHARE) -> DataFrame:
    """Pairs of different ids with equal parents (roots among themselves) and equal kind, by an equi-join.

    The pairs of a family are as many as its square, so a large family is dealt: each share of it meets a copy of the whole.
    """
    family = F.struct("parent_id", "kind").alias("_family")
    rows = nodes.where("kind is not null").select("id", family)
    sizes = rows.groupBy("_family").agg(F.ceil(F.count("*") / share).alias("_shares"))
    rows = rows.join(sizes, "_family")
    a = rows.select("id", "_family", F.pmod(F.xxhash64("id"), F.col("_shares")).alias("_share"))
    b = rows.select(F.col("id").alias("sibling_id"), "_family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share"))
    # Small tables make large ones here: they are dealt to all tasks, whatever their own size.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (side.repartition(tasks, "_family", "_share") for side in (a, b))
    return a.join(spread(b), ["_family", "_share"]).where("id <> sibling_id").select("id", "sibling_id")


def selected(nodes: DataFrame, kind: str | None = None, parent=None, root=None) -> DataFrame:
    """Rows of nodes (id, parent_id, kind, ...) of a kind, below a parent or under a root (itself included); what isn't given isn't asked."""
    out = nodes if kind is None else nodes.where(F.col("kind") == kind)
    out = out if parent is None else out.where(F.col("parent_id") == F.lit(parent))
    if root is not None:
        out = out.join(roots(nodes).where(F.col("root_id") == F.lit(root)).select("id"), "id", "left_semi")
    return out


def propagate_max(nodes: DataFrame, value: str) -> DataFrame:
    """nodes (id, parent_id, value) to (id, value): each node's greatest value among itself and all below it.

    Each round a value moves twice as far, so the work is the nodes times the logarithm of the depth. Nodes in or below
    a cycle are left out.
    """
    sound = nodes.join(spread(roots(nodes).where("state <> 'Cycle'").select("id")), "id", "left_semi")
    now = settled(sound.select("id", F.col("parent_id").alias("to"), value))
    while now.where("to is not null").take(1):
        sent = now.where("to is not null").groupBy(F.col("to").alias("id")).agg(F.max(value).alias("_more"))
        jump = now.select(F.col("id").alias("to"), F.col("to").alias("_further"))
        now = settled(now.join(spread(jump), "to", "left").join(spread(sent), "id", "left").select("id", F.col("_further").alias("to"), F.greatest(value, "_more").alias(value)))
    return now.select("id", value)
