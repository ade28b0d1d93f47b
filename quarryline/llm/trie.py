"""Prefix tree of conversations: what turns conversations have in common from their beginning.

A node of depth d stands for one sequence of d first turns (role and text); its members are the conversations that
begin so, and the smallest of them names it. The tree is built a depth at a time: the next turns of
the conversations still live are grouped by (parent node, turn), which gives the nodes of that depth;
then each conversation learns its node. A conversation that is alone in its node needs no more
grouping: the rest of its turns is a chain of nodes of its own, written in one step, so the number of levels is that of the
turns that any two conversations share. Then, from the deepest level up, the nodes of a level are joined with the
sums over their children, which gives leaves and saved tokens (here: code points) of each subtree.

Groups are counted before the shuffle, and what a conversation of any group learns comes from a join of
two written tables, which Spark may split, so neither a common first turn nor copies of one conversation gather in
a task. Turns take their place in a conversation by running sums over blocks of a sorted table, not in a window over the conversation.
The ids that end at a node are put together in blocks of BLOCK and run through the digest in order.

Defined results: rows are ordered by turn (null first), then role, then text; repeated rows are turns
like others; null roles and texts count as empty; rows with a null conv_id belong to no conversation and are left out; a
very long text counts by its digest and length; other columns aren't looked at; an empty table has no conversations, so it gives no root either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm import worker
from quarryline.operators.prefix import running_sum
from quarryline.sources.scratch import fresh_path, materialize, passing, remove

#: Powers of two: ids in a block of a node's ends; rows in a block of a conversation; copies of a turn laid out at once.
BLOCK, ROWS, COPIES = 12, 12, 16
#: Conversations that share a beginning when rebuilt, and turns they may share.
FAMILY, SHARED = 100, 5
EMPTY = hashlib.sha256(b"").hexdigest()


def borrowed(conv_id: Column) -> Column:
    """How many first turns a rebuilt conversation takes from its family's first."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (SHARED + 1)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_id (digest of role and text), chars of each turn.

    Equal rows are counted first, then sorted by range, so that one conversation may lie over many tasks.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    counted = rows.groupBy(*order).agg(F.count("*").alias("copies")).repartitionByRange(*order).sortWithinPartitions(*order)
    said = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256))
    numbered = materialize(counted.select("conv_id", F.monotonically_increasing_id().alias("at"), said.alias("turn_id"), F.length("text").cast("long").alias("chars"), "copies"), "turns")
    placed = running_sum(numbered, F.shiftright("at", ROWS), ["at"], F.col("copies"), "before", by=("conv_id",))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(1 << COPIES)))
    repeated = placed.where("copies > 1").withColumn("block", blocks).repartition("at", "block")
    each = F.explode(F.sequence(F.col("block"), F.least(F.col("block") + (1 << COPIES), F.col("copies")) - 1))
    laid = repeated.withColumn("copy", each).select("conv_id", (F.col("before") + F.col("copy") + 1).alias("place"), "turn_id", "chars")
    return placed.where("copies = 1").select("conv_id", (F.col("before") + 1).alias("place"), "turn_id", "chars").unionByName(laid)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, turn_id, chars of the rebuilt conversations; and conv_id, length of them all.

    Each begins with up to SHARED first turns of the first conversation of its family, in place of as many of its own.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    heads = materialize(turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") <= SHARED)).select(F.col("conv_id").alias("head"), "place", "turn_id", "chars"), "heads")
    known = heads.groupBy("head").agg(F.max("place").alias("there"))
    asked = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"), borrowed(F.col("conv_id")).alias("h"))
    taken = asked.join(known, "head", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)).cast("long")))
    plan = materialize(taken.select("conv_id", "head", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "plan")
    first = plan.where("taken > 0").join(heads, "head").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "turn_id", "chars")
    rest = turns.join(plan, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "turn_id", "chars")
    made = materialize(first.unionByName(rest).sortWithinPartitions("depth"), "rebuilt")
    return made, plan.select("conv_id", "length")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, sorted by node and block, run through the node's digest one after the other."""
    worker.begin("trie")
    now, digest = None, None
    for batch in batches:
        out = []
        for depth, node, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, node) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (depth, node), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["depth", "node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], ["depth", "node", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """depth, node, ends_sha256: digest of the ids (conv_id) that end at a node, ascending, with commas between."""
    block = F.shiftright("conv_id", BLOCK).alias("block")  # conversations are distinct, so a block has 2 ** BLOCK ids at most
    joined = ends.groupBy("depth", "node", block).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return joined.repartition("depth", "node").sortWithinPartitions("depth", "node", "block").select("depth", "node", "ids").mapInArrow(_digests, "depth long, node long, ends_sha256 string")


class Levels:
    """Tables of one kind, one for each depth, in one folder."""

    def __init__(self, root: str, kind: str, schema: str):
        self.root, self.schema = f"{root}/{kind}", schema

    def add(self, rows: DataFrame, depth: int) -> DataFrame:
        rows.write.parquet(f"{self.root}/depth={depth}")
        return rows.sparkSession.read.schema(self.schema).parquet(f"{self.root}/depth={depth}")

    def all(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.read.schema(f"{self.schema}, depth long").parquet(self.root)


def nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """All nodes of the tree of conversations given by conv_id, depth, turn_id, chars; lengths has them all, those without turns too.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = turns.sparkSession
    total = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).first()
    root = fresh_path(spark, "trie")
    groups = Levels(root, "groups", "parent long, turn_id binary, conv_id long, n_convs long, chars long")
    members = Levels(root, "members", "conv_id long, node long")
    sums = Levels(root, "sums", "conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    try:
        nothing = [(None, None, total["first"], total["n"], 0)] if total["n"] else []
        level = [groups.add(spark.createDataFrame(nothing, groups.schema), 0)]
        live = members.add(lengths.select("conv_id", F.lit(total["first"]).cast("long").alias("node")), 0)
        while True:
            depth = len(level)
            rows = turns.where(F.col("depth") == depth).join(live, "conv_id").select("conv_id", "node", "turn_id", "chars")
            found = rows.groupBy(F.col("node").alias("parent"), "turn_id").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
            level.append(groups.add(found, depth))
            shared = level[-1].where("n_convs > 1")
            if shared.isEmpty():
                break
            to = shared.select(F.col("parent").alias("node"), "turn_id", F.col("conv_id").alias("next"))
            live = members.add(rows.join(to, ["node", "turn_id"]).select("conv_id", F.col("next").alias("node")), depth)
        below = None
        for depth in reversed(range(len(level))):
            # a single conversation's chain saves nothing and has one leaf, however long it is
            many = level[depth].where((F.col("n_convs") > 1) | F.lit(depth == 0))
            alone = level[depth].where((F.col("n_convs") == 1) & F.lit(depth > 0)).select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
            kids = "node long, n_children long, leaves long, saved long"
            joined = many.join(spark.createDataFrame([], kids) if below is None else below, F.col("conv_id") == F.col("node"), "left")
            zero = F.lit(0).cast("long")
            own = joined.select("conv_id", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("leaves", zero + 1).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", zero)).alias("saved_tokens"))
            here = sums.add(own, depth).select("parent", "n_leaves", "saved_tokens").unionByName(alone)
            below = here.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        ended = ends_of(members.all(turns).join(lengths, "conv_id").where(F.col("depth") == F.col("length")).select("depth", "node", "conv_id"))
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        common = sums.all(turns).withColumnRenamed("parent", "parent_conv_id").join(ended.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
        tops = materialize(groups.all(turns).where("n_convs = 1 and depth > 0").select("conv_id", F.col("depth").alias("top"), "parent").join(lengths, "conv_id"), "tops")
        chains = turns.join(tops, "conv_id").where("depth >= top").select(
            "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            F.when(F.col("depth") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(F.col("depth") < F.col("length"), F.lit(EMPTY)).otherwise(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends_sha256"),
        )
        return materialize(common.select(*names).unionByName(chains.select(*names)), "nodes", lasting=True)
    finally:
        remove(spark, root)


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """The nodes of the tree of the rebuilt conversations."""
    with passing(conversations.sparkSession):
        turns, lengths = rebuilt(ordered_turns(conversations))
        return nodes(turns, lengths)
