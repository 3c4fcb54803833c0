"""Operator 6, chat formatting: a prefix tree of conversations, written depth first.

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts the escape sign ``\\`` becomes ``\\\\``, ``<|`` becomes ``<\\|``, and in roles a
line end becomes ``\\n``, so control strings cannot be forged and
everything can be read back.

Conversations that share initial turns (same roles and texts) share nodes.  A
tree holds the conversations with the same first turn; its nodes are laid
out depth first, so shared tokens stand once.  Each node has

* ``first_token`` and ``n_tokens``: its place in the tree's token sequence,
* ``first_position``: position id of its first token, the tokens of its ancestors,
* ``intervals``: the token intervals of its ancestors, merged where they touch, and then its
  own, which are what its tokens may attend to (causally),
* ``runs``: the same nodes as ranges of depths of chains,
* its text, its token ids, and whether its text is under the loss mask
  (assistant turns; the mask covers the text between role and end mark).

``leaves`` has the last node of every conversation.  Reading a
conversation back takes the runs of that node and the texts that lie there.

A node is named by a 128-bit hash of the path to it, found by one pass over each
conversation.  Different conversations of a tree are ranked by their paths, and a node
belongs to the chain of the first of them that passes it.  Depth first is then the order
of (branch, chain, depth), and a path is a few runs of chains, so that a long conversation
costs rows and bytes in proportion to its turns.

Edge cases: a null role or text is empty; rows without a conversation id form one
conversation; rows that repeat a turn number are turns in the order of role and text;
rows without a turn number come first; other columns are ignored, so their names
cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.llm import common as c

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Hexadecimal digits of the second turn's hash that tell the branches of a tree apart.
BRANCH_DIGITS = 2


def escaped(text: Column) -> Column:
    """Text without control strings."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped``; ``\\\\`` is set aside while the marks are restored."""
    aside = F.replace(text, F.lit("\\\\"), F.lit("\\0"))
    return F.replace(F.replace(aside, F.lit("<\\|"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _role_back(role: Column) -> Column:
    aside = F.replace(role, F.lit("\\\\"), F.lit("\\0"))
    return F.replace(F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def paths(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns, chain``: ``chain`` has the hash of the path to each turn."""
    plain = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = F.substring(F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256), 1, 32)
    whole = plain.withColumn("own", own).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "own"))).alias("turns"))
    # The chain of hashes: each one covers the turn and the hash before it.
    chain = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda done, t: F.concat(done, F.array(F.substring(F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), t["own"]), 256), 1, 32))),
    )
    return whole.select("conv_id", "turns", chain.alias("chain"))


def _branch() -> Column:
    """Part of a tree that the second turn chooses."""
    return F.when(F.size("chain") > 1, F.substring(F.try_element_at("chain", F.lit(2)), 1, BRANCH_DIGITS)).otherwise("")


def tree(rows: DataFrame, tokenizer_path: str, **columns) -> tuple[DataFrame, DataFrame]:
    """Nodes (see above) and ``conv_id, n_turns, tree, node`` of the last turn of every conversation."""
    c.small_batches(rows.sparkSession)
    whole = c.stored(paths(rows, **columns))
    above = F.concat(F.array(F.lit(None).cast("string")), F.slice("chain", 1, F.size("chain") - 1))
    every = whole.select(F.element_at("chain", 1).alias("tree"), _branch().alias("branch"), F.posexplode(F.arrays_zip("turns", F.col("chain").alias("node"), above.alias("parent"))).alias("depth", "t"))
    every = every.select("tree", F.when(F.col("depth") > 0, F.col("branch")).otherwise("").alias("branch"), "depth", "t.node", "t.parent", "t.turns.role", "t.turns.text")
    nodes = every.groupBy("tree", "node").agg(*[F.first(x).alias(x) for x in ("branch", "depth", "parent", "role", "text")])
    is_loss = F.col("role") == LOSS_ROLE
    head = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))
    nodes = nodes.select("tree", "node", "parent", "branch", "depth", is_loss.alias("is_loss"), F.length(head).alias("loss_start"), F.length(escaped(F.col("text"))).alias("loss_length"), F.concat(head, escaped(F.col("text")), F.lit(END + "\n")).alias("formatted"))

    names = nodes.columns

    def tokenize(batches):
        import os

        import tokenizers

        # A task has one core; threads of its own would only cost memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = tokenizers.__dict__.setdefault("_canopygrid_tokenizers", {})
        if tokenizer_path not in kept:
            kept[tokenizer_path] = tokenizers.Tokenizer.from_file(tokenizer_path)
            kept[tokenizer_path].encode_special_tokens = True
        encode = kept[tokenizer_path].encode_batch_fast
        for batch in batches:
            found = [np.array(encode([text], add_special_tokens=False)[0].ids, dtype=np.int32) for text in batch.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32())), pa.array([len(x) for x in found], pa.int64())], names=[*names, "ids", "n_tokens"])

    schema = nodes.withColumn("ids", F.lit(None).cast("array<int>")).withColumn("n_tokens", F.lit(None).cast("long")).schema
    nodes = c.stored(nodes.mapInArrow(tokenize, schema))
    # Different conversations by rank among those of their branch; a node's chain is the first rank that passes it.
    paths_of = whole.withColumn("leaf", F.element_at("chain", -1)).groupBy("leaf").agg(F.first("chain").alias("chain"))
    in_order = Window.partitionBy("tree", "branch").orderBy("path")
    ranked = paths_of.select(F.element_at("chain", 1).alias("tree"), _branch().alias("branch"), F.array_join("chain", "").alias("path"), "chain")
    ranked = c.stored(ranked.select("tree", "branch", F.row_number().over(in_order).alias("rank"), "chain"))
    steps = ranked.select("tree", "branch", "rank", F.posexplode("chain").alias("depth", "node"))
    owners = steps.filter("depth > 0").groupBy("tree", "node").agg(F.min("rank").alias("chain"))
    owned = nodes.select("tree", "node", "branch", "depth", "n_tokens").join(owners, ["tree", "node"], "left").withColumn("chain", F.coalesce("chain", F.lit(0)))
    # Running sums in this order, within branches of a tree and then over its branches, so that a hot tree is spread over tasks.
    earlier = Window.partitionBy("tree").orderBy("branch").rowsBetween(Window.unboundedPreceding, -1)
    branches = owned.groupBy("tree", "branch").agg(F.sum("n_tokens").alias("size")).select("tree", "branch", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("tree", "branch").orderBy("chain", "depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = owned.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(branches, ["tree", "branch"])
    places = c.stored(placed.select("tree", "node", "branch", "chain", "depth", (F.col("base") + F.col("inside")).alias("start"), (F.col("base") + F.col("inside") + F.col("n_tokens")).alias("end")))
    # The path of a conversation: one run of touching nodes for each chain that it follows.
    passed = steps.drop("depth").join(places.withColumnRenamed("branch", "of"), ["tree", "node"])
    runs = passed.groupBy("tree", "branch", "rank", "of", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("depth").alias("first_depth"), F.max("depth").alias("last_depth"))
    run = F.struct("start", "end", F.col("of").alias("branch"), "chain", "first_depth", "last_depth")
    followed = runs.groupBy("tree", "branch", F.col("rank").alias("chain")).agg(F.array_sort(F.collect_list(run)).alias("found"))
    # A node follows the runs of its chain, the last of them down to itself; the first node has no chain.
    last, none = F.element_at("found", -1), F.array().cast("array<struct<start:bigint,end:bigint>>")
    prior = F.coalesce(F.slice("found", 1, F.size("found") - 1), F.array().cast("array<struct<start:bigint,end:bigint,branch:string,chain:int,first_depth:int,last_depth:int>>"))
    same_chain = F.when(last["start"] < F.col("start"), F.array(F.struct(last["start"].alias("start"), F.col("start").alias("end")))).otherwise(none)
    intervals = F.concat(F.transform(prior, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), same_chain, F.array(F.struct("start", "end")))
    here = F.struct(F.col("branch"), F.col("chain"), F.coalesce(last["first_depth"], F.col("depth")).alias("first_depth"), F.col("depth").alias("last_depth"))
    above = F.transform(prior, lambda x: F.struct(x["branch"].alias("branch"), x["chain"].alias("chain"), x["first_depth"].alias("first_depth"), x["last_depth"].alias("last_depth")))
    laid = places.join(followed, ["tree", "branch", "chain"], "left").select("tree", "node", "chain", F.col("start").alias("first_token"), intervals.alias("intervals"), F.concat(above, F.array(here)).alias("runs"))
    total = F.aggregate("intervals", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    nodes = nodes.join(c.stored(laid), ["tree", "node"]).withColumn("first_position", total - F.col("n_tokens"))
    leaves = whole.select("conv_id", F.size("chain").alias("n_turns"), F.element_at("chain", 1).alias("tree"), F.element_at("chain", -1).alias("node"))
    return nodes, leaves


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``conv_id, at, role, text, is_loss, loss_text, formatted`` of every turn, from the written trees alone."""
    followed = leaves.join(nodes.select("tree", "node", "runs"), ["tree", "node"]).select("conv_id", "tree", F.explode("runs").alias("run"))
    steps = followed.select("conv_id", "tree", "run.branch", "run.chain", F.explode(F.sequence("run.first_depth", "run.last_depth")).alias("depth"))
    found = steps.join(nodes.select("tree", "branch", "chain", "depth", "first_token", "formatted", "is_loss", "loss_start", "loss_length"), ["tree", "branch", "chain", "depth"])
    body = F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START) + len(END) + 1})")
    split = F.locate("\n", body)
    role, text = F.substring(body, F.lit(1), split - 1), body.substr(split + 1, F.length(body))
    loss = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))
    return found.select("conv_id", F.col("first_token").alias("at"), _role_back(role).alias("role"), unescaped(text).alias("text"), "is_loss", F.when(F.col("is_loss"), unescaped(loss)).otherwise("").alias("loss_text"), "formatted")


def digests(turns_back: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    whole = turns_back.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "loss_text", "formatted"))).alias("t"))
    written = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("t.loss_text"), "")
    return whole.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + F.length(x["formatted"])).alias("formatted_chars"),
    )
