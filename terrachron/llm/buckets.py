"""Linking the members of shared keys without expanding a key into all its pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.llm.common import materialise, small_side
from terrachron.llm.components import connected_components


def _apart(members: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, id, c, facts) of the members of keys that hold more than one component c."""
    now = members.join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = now.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    return materialise(now.join(mixed, "key").join(facts, "id"))


#: Pairs of different components for each member of a key beyond which they don't meet as rows, where there is another way.
CROWD = 16


def _by_component(apart: DataFrame) -> DataFrame:
    """(key, n, same): the members of a key, and the sum of the squares of how many each component has."""
    return apart.groupBy("key", "c").agg(F.count("*").cast("double").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))


def _pairs_to_meet(of: DataFrame) -> tuple[float, float]:
    """How many members there are, and how many pairs of them are of one key and of different components."""
    n, pairs = of.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
    return n or 0.0, pairs or 0.0


def linked_components(keys: DataFrame, facts_of: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], confirm: Callable[[DataFrame], DataFrame], links: DataFrame | None = None, first: Callable[[str, str, str], Column] | None = None, rounds: int = 0, meet: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the confirmed links among ids that share a key; nodes that are their component's least id are left out.

    keys: (key, id), repeats allowed. facts_of: a table of ids that share a key to (id, ...), what `near` compares, given the suffixes of
    two sides. confirm: pairs (a, b) to the linked ones. links: (a, b) that hold already. first: given a key column and
    the suffixes, whether the key is the first that two ids share, so that they meet once. rounds: how often, at most,
    members that are still apart are first compared with one of their key, while that is less work than that all meet and each round halves it.
    meet: members (key, id, c, ...) of keys with more than CROWD pairs for each member still apart to links (a, b) that hold, enough to join what can be joined; without it they meet as rows like others.

    First each id is compared with the least and the greatest id that it shares a key with. Links found are contracted,
    and only members of a key that are still apart meet each other, so the components are those of all links, while a
    large group of alike members costs two pairs for each, and one more for each round.
    """
    shared = materialise(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).where("lo <> hi"))
    members = materialise(keys.join(small_side(shared.where("c > 2").select("key", "lo", "hi")), "key").distinct())
    ends = members.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    stars = ends.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.*").where("a <> b")
    pairs = materialise(stars.union(shared.where("c = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))).distinct())
    facts = facts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    names = [c for c in facts.columns if c != "id"]
    sides = [facts.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "ab"]
    found_links = materialise(confirm(materialise(pairs.join(sides[0], "a").join(sides[1], "b").where(near("_a", "_b")).select("a", "b"))))
    found = connected_components(found_links if links is None else found_links.union(links))
    apart = _apart(members, found, facts)
    of = None
    before = float("inf")
    for i in range(rounds):
        # A round costs about as much as 32 pairs for each member, and the next one only pays if this one halves them.
        of = materialise(_by_component(apart))
        n, pairs = _pairs_to_meet(of)
        if pairs <= 32 * n or pairs > before / 2:
            break
        before = pairs
        centre = apart.groupBy("key").agg(F.min_by(F.struct("id", "c", *names), F.xxhash64(F.lit(i), "id")).alias("m"))
        centre = centre.select(F.col("key").alias("key_a"), *(F.col(f"m.{c}").alias(f"{c}_a") for c in ("id", "c", *names)))
        others = apart.select(*(F.col(c).alias(f"{c}_b") for c in ("key", "id", "c", *names)))
        stars = others.join(centre, (F.col("key_a") == F.col("key_b")) & (F.col("c_a") != F.col("c_b")) & near("_a", "_b"))
        more = materialise(confirm(materialise(stars.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())))
        if not more.take(1):
            break
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        apart, of = _apart(members, found, facts), None
    if not apart.take(1):
        return found
    if meet:
        crowds = (_by_component(apart) if of is None else of).where((F.col("n") * F.col("n") - F.col("same")) / 2 > CROWD * F.col("n")).select("key")
        crowded = materialise(apart.join(small_side(crowds), "key"))
        if crowded.take(1):
            more = materialise(meet(crowded))
            found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
            apart = _apart(members.join(crowded.select("key").distinct(), "key", "left_anti"), found, facts)
            if not apart.take(1):
                return found
    x, y = (apart.select(*(F.col(c).alias(f"{c}_{s}") for c in ("key", "id", "c", *names))) for s in "ab")
    together = (F.col("key_a") == F.col("key_b")) & (F.col("c_a") < F.col("c_b"))
    together = together & (first("key_a", "_a", "_b") if first else F.lit(True)) & near("_a", "_b")
    more = x.join(y, together).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    more = materialise(confirm(materialise(more if first else more.distinct())))
    if not more.take(1):
        return found
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
