"""Prefix trie of conversations by the Euler-tour technique.

Turns.  The rows are dealt by ranges of (conversation, turn) and numbered by
partition offsets, so no conversation is sorted whole by one task.  A sequence
of turns is known by the XOR of two 64-bit hashes of every (position, role,
text), a prefix sum that is taken in chunks of turns; two different sequences
share both with probability about n^2 / 2^129.  Grouping by (depth, hashes)
gives the nodes, map-side first, so a first turn that very many conversations
share is reduced before it moves.

Tour.  Nodes get ids in the order of (smallest member, depth).  Every node has
an enter and an exit arc; entering leads to the first child or the own exit,
leaving to the next sibling or the parent's exit.  The list is ranked in two
steps: tasks contract the runs of arcs inside blocks of ``BLOCK`` ids, and the
links that are left are ranked by pointer doubling in Spark joins, each pointer
a key of its own.  Leaves and savings stand at the enter arcs; prefix sums over
the arcs' positions, in blocks of positions, give every subtree as a difference.

Member lists.  The ids that end at a node are put in order in groups of at most
``IDS`` neighbouring numbers, and one pass over the groups of a node, in order
and without holding them, hashes them.

Defined cases: a null role or text is empty; a null turn comes first; rows of
one turn are ordered by role, then text, and repeated rows are turns of their
own; rows without conv_id are no conversation; a conversation without turns is
a member of the root; an empty table has no nodes; turn and text of any length
are kept whole; other columns are ignored.  Rows of one turn that agree in the
first 32 characters of a role or 64 of a text longer than that are ordered by
one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PREFIX_OF = 100            # the conversation that lends its first turns is the last multiple of this
MAX_HEAD = 6               # the number of lent turns is below this
BLOCK_BITS = 16            # arcs of a contraction block
CHUNK_BITS = 10            # turns of a chunk of prefix hashes
SUM_BITS = 12              # positions of a block of prefix sums
ID_BITS = 12               # ids of a group of members
SIBLING_BITS = 15          # node ids of a group of siblings
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, e1, e2, chars): ``at`` numbers all turns without gaps, in order inside a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    # ranges follow role, then text, as far as their first characters tell; equal rows that are whole in
    # these are told apart by a salt, so that they may be dealt to several tasks
    more_role, more_text = F.length("role") > 32, F.length("text") > 64
    dealt = t.withColumn("salt", F.when(~more_role & ~more_text, F.monotonically_increasing_id())).repartitionByRange(
        F.col("conv_id"), F.col("turn").asc_nulls_first(), F.left("role", F.lit(32)), more_role,
        F.when(~more_role, F.left("text", F.lit(64))), more_text, F.col("salt"))
    dealt = dealt.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text")
    rows = materialize(dealt.select("conv_id", F.monotonically_increasing_id().alias("id"),
                                    F.xxhash64(F.lit(1), "role", "text").alias("e1"),
                                    F.xxhash64(F.lit(2), "role", "text").alias("e2"),
                                    F.length("text").alias("chars")), "trie_turns")
    part = F.shiftright("id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    offsets = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (rows.withColumn("part", part).join(F.broadcast(offsets), "part")
            .select("conv_id", (F.col("offset") + F.col("id") - F.shiftleft("part", 33)).alias("at"), "e1", "e2", "chars"))


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, turns): conversations with their number of rebuilt turns, and the rebuilt turns.

    ``convs`` has conv_id and n; ``turns`` conv_id, d (from 1), e1, e2, chars.
    """
    rows = ordered_turns(conversations)
    own = rows.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("own"))
    own = materialize(own, "trie_conversations")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MAX_HEAD
    lender = own.select(F.col("conv_id").alias("base"), F.least("own", F.lit(MAX_HEAD)).alias("lent"))
    convs = (own.withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % PREFIX_OF)
             .join(lender, "base", "left").withColumn("k", F.least("h", F.coalesce("lent", F.lit(0))))
             .select("conv_id", "base", "start", "h", "k",
                     (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    convs = materialize(convs, "trie_heads")
    placed = rows.join(convs, "conv_id").withColumn("pos", F.col("at") - F.col("start"))
    placed = materialize(placed.select("conv_id", "pos", "h", "k", "e1", "e2", "chars"), "trie_placed")
    kept = placed.where("pos >= h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("d"), "e1", "e2", "chars")
    first = placed.where((F.col("pos") < MAX_HEAD) & (F.col("conv_id") % PREFIX_OF == 0)).select(
        F.col("conv_id").alias("base"), "pos", "e1", "e2", "chars")
    lent = convs.select("conv_id", "base", "h").join(first, "base").where("pos < h").select(
        "conv_id", (F.col("pos") + 1).alias("d"), "e1", "e2", "chars")
    return convs.select("conv_id", "n"), kept.unionByName(lent)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns`` with the hashes x1, x2 of the first d turns and p1, p2 of the first d - 1."""
    t = turns.withColumn("chunk", F.shiftright(F.col("d") - 1, CHUNK_BITS))
    t = t.select("conv_id", "d", "chunk", "chars", *[F.xxhash64(F.lit(i), "d", "e1", "e2").alias(f"t{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    inside = t.select("*", *[F.bit_xor(f"t{i}").over(upto).alias(f"c{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = t.groupBy("conv_id", "chunk").agg(*[F.bit_xor(f"t{i}").alias(f"s{i}") for i in (1, 2)])
    base = whole.select("conv_id", "chunk", *[F.bit_xor(f"s{i}").over(earlier).alias(f"b{i}") for i in (1, 2)]).where("chunk > 0")
    out = inside.join(base, ["conv_id", "chunk"], "left")
    for i in (1, 2):
        out = out.withColumn(f"x{i}", F.col(f"c{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))))
        out = out.withColumn(f"p{i}", F.col(f"x{i}").bitwiseXOR(F.col(f"t{i}")))
    return out.select("conv_id", "d", "chars", "x1", "x2", "p1", "p2")


_KEY = ["d", "x1", "x2"]


def _digests(batches):
    """One row per run of equal keys: the SHA-256 of the texts of its rows, comma-joined."""
    key, state, out = None, None, []

    def batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),))],
                                          names=[*_KEY, "ends_sha256"])

    for b in batches:
        for d, x1, x2, ids in zip(*[b.column(c).to_pylist() for c in (*_KEY, "ids")]):
            if (d, x1, x2) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (d, x1, x2), hashlib.sha256(ids.encode())
        if len(out) > 5_000:
            yield batch(out)
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield batch(out)


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, x1, x2, ends_sha256) of the nodes at which the conversations of ``ends`` end."""
    group = F.shiftright("conv_id", ID_BITS)
    blocks = ends.groupBy(*_KEY, group.alias("group")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    blocks = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "group").select(*_KEY, "ids")
    return blocks.mapInArrow(_digests, "d long, x1 long, x2 long, ends_sha256 string")


def nodes_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node, ``g`` numbering them by (smallest member, depth)."""
    rows = materialize(prefix_hashes(turns), "trie_prefixes")
    zero = F.lit(0).cast("long")
    inner = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
                                    F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("d"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", F.lit(0).alias("chars"),
        zero.alias("p1"), zero.alias("p2"))
    last = rows.join(convs.where("n > 0").withColumnRenamed("n", "d"), ["conv_id", "d"], "left_semi").select(*_KEY, "conv_id")
    ends = last.unionByName(convs.where("n = 0").select(zero.alias("d"), zero.alias("x1"), zero.alias("x2"), "conv_id"))
    nodes = inner.unionByName(root).join(end_digests(ends), _KEY, "left")
    dealt = nodes.repartitionByRange("conv_id", "d").sortWithinPartitions("conv_id", "d")
    return materialize(dealt.select(F.monotonically_increasing_id().alias("g"), *nodes.columns), "trie_nodes")


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``pg`` and ``parent_conv_id``; the root, which may have very many children, joins as one row."""
    up = nodes.select(F.col("d").alias("pd"), F.col("x1").alias("px1"), F.col("x2").alias("px2"), F.col("g").alias("pg"),
                      F.col("conv_id").alias("parent_conv_id"))
    root = up.where("pd = 0").select((F.col("pd") + 1).alias("d"), "pg", "parent_conv_id")
    keep = ["g", "d", "conv_id", "n_convs", "chars", "ends_sha256", "pg", "parent_conv_id"]
    deep = nodes.where("d > 1").join(up.where("pd > 0"), (F.col("d") - 1 == F.col("pd")) & (F.col("p1") == F.col("px1"))
                                     & (F.col("p2") == F.col("px2")))
    return (deep.select(*keep)
            .unionByName(nodes.where("d = 1").join(F.broadcast(root), "d").select(*keep))
            .unionByName(nodes.where("d = 0").select(*[F.col(c) if c in nodes.columns else F.lit(None).cast("long").alias(c) for c in keep])))


def with_siblings(tree: DataFrame) -> DataFrame:
    """``tree`` with ``sibling``, the next child of the same parent by id; siblings in groups of neighbouring ids."""
    t = tree.withColumn("group", F.shiftright("g", SIBLING_BITS))
    child = t.where("pg is not null")
    near = child.withColumn("near", F.lead("g").over(Window.partitionBy("pg", "group").orderBy("g")))
    far = child.groupBy("pg", "group").agg(F.min("g").alias("least")).select(
        "pg", "group", F.lead("least").over(Window.partitionBy("pg").orderBy("group")).alias("far"))
    far = far.where("far is not null")
    out = near.join(far, ["pg", "group"], "left").withColumn("sibling", F.coalesce("near", "far"))
    return out.select(*tree.columns, "sibling").unionByName(
        tree.where("pg is null").withColumn("sibling", F.lit(None).cast("long")))


def contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of arcs that follow each other inside one block: each arc with its run's first arc and its place
    in the run; the first arc also with the run's length and the arc after it (-1: none)."""
    pdf = pdf.sort_values("arc", ignore_index=True)
    arc, nxt, n = pdf["arc"].to_numpy(), pdf["next"].to_numpy(), len(pdf)
    at = np.minimum(np.searchsorted(arc, nxt), n - 1)
    inside = arc[at] == nxt
    up, place = np.arange(n), np.zeros(n, np.int64)
    up[at[inside]] = np.flatnonzero(inside)
    place[at[inside]] = 1
    while True:
        place, far = place + place[up], up[up]
        if np.array_equal(far, up):
            break
        up = far
    tail = np.flatnonzero(~inside)
    length, after = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    length[up[tail]] = place[tail] + 1
    after[up[tail]] = nxt[tail]
    return pd.DataFrame({"arc": arc, "head": arc[up], "place": place, "length": length, "after": after,
                         "leaf": pdf["leaf"], "saved": pdf["saved"]})


def list_rank(tour: DataFrame) -> DataFrame:
    """``tour`` (arc, next, leaf, saved; -1 after the last arc) with ``pos``, the arc's place in the list from 0."""
    runs = materialize(tour.withColumn("block", F.shiftright("arc", BLOCK_BITS)).groupBy("block").applyInPandas(
        lambda pdf: contract(pdf.drop(columns="block")),
        "arc long, head long, place long, length long, after long, leaf long, saved long"), "trie_runs")
    # pointer doubling: `left` arcs from the run's first arc to `after`, in the end to the end of the list
    r = materialize(runs.where("arc = head").select("head", "after", F.col("length").alias("left")), "trie_links")
    while r.where("after >= 0").limit(1).count():
        jump = r.select(F.col("head").alias("after"), F.col("after").alias("then"), F.col("left").alias("more"))
        moved = r.where("after >= 0").join(jump, "after").select("head", F.col("then").alias("after"),
                                                                 (F.col("left") + F.col("more")).alias("left"))
        r = materialize(moved.unionByName(r.where("after < 0").select("head", "after", "left")), "trie_links")
    total = r.agg(F.max("left")).first()[0] or 0
    return runs.join(r.select("head", "left"), "head").select(
        "arc", (F.lit(total) - F.col("left") + F.col("place")).alias("pos"), "leaf", "saved")


def prefix_sums(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """``ranked`` with the sums of ``columns`` up to and with each ``pos``: in blocks, over blocks, over groups of blocks."""
    def before(*part):
        w = Window.partitionBy(*part) if part else Window
        return w.orderBy("block" if part else "wide").rowsBetween(Window.unboundedPreceding, -1)

    r = ranked.withColumn("block", F.shiftright("pos", SUM_BITS))
    sums = r.groupBy("block").agg(*[F.sum(c).alias(f"s_{c}") for c in columns])
    sums = sums.withColumn("wide", F.shiftright("block", SUM_BITS))
    inner = sums.select("block", "wide", *[F.coalesce(F.sum(f"s_{c}").over(before("wide")), F.lit(0)).alias(f"i_{c}") for c in columns])
    outer = sums.groupBy("wide").agg(*[F.sum(f"s_{c}").alias(f"w_{c}") for c in columns])
    outer = outer.select("wide", *[F.coalesce(F.sum(f"w_{c}").over(before()), F.lit(0)).alias(f"o_{c}") for c in columns])
    base = inner.join(outer, "wide").select("block", *[(F.col(f"i_{c}") + F.col(f"o_{c}")).alias(f"b_{c}") for c in columns])
    upto = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = r.select("*", *[F.sum(c).over(upto).alias(f"u_{c}") for c in columns])
    return own.join(base, "block").select(*ranked.columns, *[(F.col(f"u_{c}") + F.col(f"b_{c}")).alias(f"sum_{c}") for c in columns])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations."""
    nodes = nodes_of(*rebuild(conversations))
    tree = materialize(with_parents(nodes), "trie_tree")
    children = tree.where("pg is not null").groupBy(F.col("pg").alias("g")).agg(
        F.min("g").alias("first_child"), F.count("*").alias("n_children"))
    tree = with_siblings(tree).join(children, "g", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = materialize(tree, "trie_arcs")
    enter, leave = F.col("g") * 2, F.col("g") * 2 + 1
    none = F.lit(-1).cast("long")
    arcs = tree.select(F.explode(F.array(
        F.struct(enter.alias("arc"), F.coalesce(F.col("first_child") * 2, leave).alias("next"),
                 (F.col("n_children") == 0).cast("long").alias("leaf"),
                 ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")),
        F.struct(leave.alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("pg") * 2 + 1, none).alias("next"),
                 F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved")))).alias("a")).select("a.*")
    sums = prefix_sums(list_rank(arcs), ["leaf", "saved"])

    def subtree(c):                # up to the exit, less what came before the enter arc
        return F.sum(F.when(F.col("arc") % 2 == 1, F.col(f"sum_{c}")).otherwise(F.col(c) - F.col(f"sum_{c}")))

    below = sums.groupBy(F.shiftright("arc", 1).alias("g")).agg(subtree("leaf").alias("n_leaves"), subtree("saved").alias("saved_tokens"))
    return tree.join(below, "g").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
