"""Merkle manifest of a dataset: a tree per group, a tree over the groups, a proof per row.

A leaf is the digest of a row's fields. The leaves of a group, in order, are joined three by three
until one node is left, its subroot; the subroots, in order of their groups, likewise give the root.
A proof lists the siblings of a node, level by level up to the root.

Trees are cut into superblocks, subtrees of ``BLOCK`` neighbouring nodes of one group, so a group of any size is
spread over many tasks. On the way up each superblock gives its top node, the next
level's leaf; a level has ``BLOCK`` times fewer rows than the one below. On the way down the nodes of a
superblock are cogrouped with the one row of outer nodes that it needs, the proof of its top: there the local
reduction is finished, the proofs are joined to the outer one, and each leaf is folded up to the root.

A null field is part of its leaf (``-``), a null group is a group of its own, first in order, and a null order
key comes before all others. Rows with equal keys are ordered by their leaf; rows that are equal in all
fields get neighbouring places in any order. Texts of any length are hashed whole, where they are read, and never
shuffled. An empty table has no root and an empty manifest. Columns that aren't fields are not looked at, whatever
they are called.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import written
from wardspark.operators.ranking import running_total

FAN, BLOCK_LEVELS = 3, 6
BLOCK = FAN ** BLOCK_LEVELS
PATH = "lefts array<string>, rights array<string>, subroot string"


def leaf(values: list[Column]) -> Column:
    """Digest of the values: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(
        F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _levels(digests: list[str], block: int) -> list[list[str]]:
    """The nodes of a superblock by level. Only the first superblock of a group can be the group's only one:
    it is reduced until one node is left, any other by all of its levels."""
    levels = [digests]
    while (len(levels) <= BLOCK_LEVELS) if block else (len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([_hash("".join(below[i:i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def _proofs(levels: list[list[str]]) -> list[tuple[list[str], list[str]]]:
    """Siblings to the left and right of each node of the lowest level, level by level."""
    sides = []
    for nodes in levels[:-1]:
        runs = range(0, len(nodes), FAN)
        sides.append([("".join(nodes[r:i]), "".join(nodes[i + 1:r + FAN]))
                      for r in runs for i in range(r, min(r + FAN, len(nodes)))])
    out = []
    for i in range(len(levels[0])):
        own = [side[i // FAN ** level] for level, side in enumerate(sides)]
        out.append(([a for a, _ in own], [b for _, b in own]))
    return out


def _top(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("at")
    top = _levels(nodes["digest"].tolist(), int(key[1]))[-1][0]
    return pd.DataFrame({"grp": [key[0]], "at": [key[1]], "digest": [top]})


def _joined(nodes: pd.DataFrame, outer: pd.DataFrame):
    """Per node of a superblock: its row, the whole proof, the subroot."""
    nodes = nodes.sort_values("at")
    levels = _levels(nodes["digest"].tolist(), int(nodes["block"].iloc[0]))
    above = outer.iloc[0]
    lefts, rights = list(above["lefts"]), list(above["rights"])
    proofs = [(a + lefts, b + rights) for a, b in _proofs(levels)]
    return nodes, proofs, above["subroot"]


def _descend(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    nodes, proofs, subroot = _joined(nodes, outer)
    return pd.DataFrame({"grp": nodes["grp"], "at": nodes["at"],
                         "lefts": [a for a, _ in proofs], "rights": [b for _, b in proofs],
                         "subroot": [subroot] * len(nodes)})


def _fold(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    nodes, proofs, subroot = _joined(nodes, outer)
    folded = []
    for node, (lefts, rights) in zip(nodes["shown"], proofs):
        for a, b in zip(lefts, rights):
            node = _hash(a + node + b)
        folded.append(node)
    return pd.DataFrame({
        "key": nodes["key"], "leaf": nodes["digest"], "subroot": [subroot] * len(nodes),
        "proof_sha256": [_hash("".join(x for pair in zip(a, b) for x in pair)) for a, b in proofs],
        "folded_root": folded})


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"`at` div {BLOCK}"))


class _Tree:
    """The levels of superblocks over ``grp, at, digest``; ``at`` counts a group's nodes from 0."""

    def __init__(self, nodes: DataFrame, label: str):
        group = nodes.select("grp").schema[0].dataType.simpleString()
        self.label, self.group, self.levels = label, group, [nodes]
        while True:
            tops = _blocks(self.levels[-1]).select("grp", "block", "at", "digest").groupBy(
                "grp", "block").applyInPandas(_top, f"grp {group}, at long, digest string")
            self.levels.append(written(tops, f"{label}-tops"))
            if not self.levels[-1].filter("at > 0").limit(1).count():
                break

    def tops(self) -> DataFrame:
        """``grp, at = 0, digest`` of each group."""
        return self.levels[-1]

    def descend(self, outer: DataFrame, to: int) -> DataFrame:
        """Proofs of the nodes of level ``to``; ``outer`` has those of the groups' tops."""
        for level in range(len(self.levels) - 2, to - 1, -1):
            outer = written(_cogrouped(self.levels[level], outer).applyInPandas(
                _descend, f"grp {self.group}, at long, {PATH}"), f"{self.label}-proofs")
        return outer


def _cogrouped(nodes: DataFrame, outer: DataFrame):
    return _blocks(nodes).groupBy("grp", "block").cogroup(
        outer.withColumnRenamed("at", "block").groupBy("grp", "block"))


def manifest(docs: DataFrame, fields: list[str], order: str, group: str,
             shown: dict[str, Column] | None = None) -> DataFrame:
    """``order, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row of ``docs``.

    ``shown`` replaces fields by what is to be verified. ``folded_root`` is recomputed from the leaf of those and the
    siblings in the manifest; ``verified`` says that it is the root.
    """
    shown = shown or {}
    kind = docs.schema[order].dataType
    # keys pass through pandas as text, which keeps nulls and all digits
    leaves = written(docs.select(
        F.col(group).alias("grp"), F.col(order).alias("place"),
        F.col(order).cast("string").alias("key"), leaf([F.col(f) for f in fields]).alias("digest"),
        leaf([shown.get(f, F.col(f)) for f in fields]).alias("shown"),
        # a number of the row lets many equal rows spread over many slices
        F.monotonically_increasing_id().alias("nth")), "leaves")
    numbered = running_total(leaves, ["grp"], ["place", "digest", "nth"], "upto")
    nodes = written(numbered.select("grp", (F.col("upto") - 1).alias("at"), "key", "digest", "shown"),
                    "numbered")
    groups = _Tree(nodes, "groups")
    subroots = running_total(groups.tops().select(F.lit(0).alias("all"), "grp", "digest"), ["all"],
                             ["grp"], "upto")
    subroots = written(subroots.select(F.lit(0).alias("grp"), (F.col("upto") - 1).alias("at"), "digest",
                                       F.col("grp").alias("named")), "subroots")
    whole = _Tree(subroots.select("grp", "at", "digest"), "whole")
    top = whole.tops().head()  # one row, none without documents
    root = top["digest"] if top else None
    none = F.array().cast("array<string>")
    outer = whole.descend(whole.tops().select("grp", "at", none.alias("lefts"), none.alias("rights"),
                                              F.lit(None).cast("string").alias("subroot")), 0)
    outer = subroots.join(outer.drop("grp", "subroot"), "at").select(
        F.col("named").alias("grp"), F.lit(0).cast("long").alias("at"), "lefts", "rights",
        F.col("digest").alias("subroot"))
    outer = groups.descend(outer, 1)
    folded = _cogrouped(nodes, outer).applyInPandas(
        _fold, "key string, leaf string, subroot string, proof_sha256 string, folded_root string")
    return folded.select(
        F.col("key").cast(kind).alias(order), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256",
        "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
