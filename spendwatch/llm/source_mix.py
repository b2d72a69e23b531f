"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree [native].

Documents of a source are permuted by a hash and cut into blocks of about
``BLOCK_WORDS`` words.  A source whose target is r times its size contributes
every block floor(r) times and the first blocks of the permutation once more,
up to the target (the boundary block is cut at a document).  The block copies
of each source are its exact quota.  A binary tree splits the quotas among
output shards: at each node the left half's share of every source is drawn
from the multivariate hypergeometric law, sources one after another, so every
quota is used up exactly and shards differ by one block at most.  A shard
takes disjoint runs of the permuted blocks and is shuffled locally by a hash:
``mix_documents`` returns shard after shard, each in the order of a seeded hash.

All draws come from md5 of seeds, so reruns agree.  The tables that grow are
only ever grouped or joined by (source, block); windows run over 1,024 blocks
at most, and the per-source tables have one row per source.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null
source is a source of its own, sorted last; rows that share a doc_id or have
none are told apart by their texts, and rows that repeat both by a number ``r``
from 0 (each is drawn by itself, so a source misses its target by half a
document at most, however many rows repeat); equal hashes are ordered by
doc_id, text hash and ``r``; a very long text is one row and may be larger than
a block; an empty table gives an empty result; other columns are ignored, and
decide in ``place`` which of the repeated rows has which number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TRIM, WORD_GAP, materialize, small_side

BLOCK_WORDS = 20_000
SHARDS = 8
MAX_REPEATS = 3
SEED = "mix-1"
_SUPER = 1024


def n_words(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(TRIM))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WORD_GAP))).cast("long")


def unit_hash(*cols) -> Column:
    """A uniform number in [0, 2^52) from md5 of the columns; DuckDB can repeat it."""
    s = F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str)
                                        else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: size, weight, target.

    Reshared excess settles at min(3 * size, level * weight): sources sorted by
    3 * size / weight are capped as long as the level that the others would
    reach is above their cap.  The input has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("cap", MAX_REPEATS * F.col("source_size").cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weight_from", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_from"))
    s = s.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return s.select("source", "source_size", "weight",
                    F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def split_quotas(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source_no, shard, lo, hi): the run of block copies of each source that a shard takes.

    ``quotas`` has one row (array of per-source copies, in source order).  Each
    level doubles the rows: a node of ``w`` shards gives its left half
    round(total * left / w) blocks, drawn source by source.  The draw inverts
    the hypergeometric distribution at a seeded uniform; its weights are built
    outwards from the mode and cover twelve standard deviations.
    """
    node = quotas.select(F.lit(0).alias("first"), F.lit(shards).alias("width"), "q")
    depth = max(1, (shards - 1).bit_length())
    for d in range(depth):
        left_w = F.floor(F.col("width") / 2).cast("int")
        node = node.withColumn("lw", left_w)
        node = node.withColumn("total", F.expr("aggregate(q, 0D, (a, x) -> a + x)"))
        node = node.withColumn("goal", F.when(F.col("width") > 1, F.round(F.col("total") * F.col("lw") / F.col("width")))
                               .otherwise(F.lit(0.0)))
        u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.lit("node"), F.lit(d), F.col("first"))
                                      .cast("binary")), 1, 12), 16, 10).cast("long"))
        node = node.withColumn("seed", u)
        # K blocks of this source, rest blocks of this and later sources, need still to draw
        node = node.withColumn("left", F.expr("""
          aggregate(transform(q, (x, i) -> struct(x as x, i as i)),
            struct(total as rest, goal as need, cast(array() as array<double>) as out),
            (a, e) -> struct(a.rest - e.x as rest,
               a.need - {draw} as need, concat(a.out, array({draw})) as out),
            a -> a.out)""".format(draw=_DRAW)))
        node = node.withColumn("right", F.expr("transform(q, (x, i) -> x - left[i])"))
        node = node.select(F.explode(F.array(
            F.struct(F.col("first"), F.when(F.col("width") > 1, F.col("lw")).otherwise(F.lit(1)).alias("width"),
                     F.when(F.col("width") > 1, F.col("left")).otherwise(F.col("q")).alias("q")),
            F.struct((F.col("first") + F.col("lw")).alias("first"),
                     F.when(F.col("width") > 1, F.col("width") - F.col("lw")).otherwise(F.lit(0)).alias("width"),
                     F.col("right").alias("q")))).alias("n")).select("n.*").where("width > 0")
    rows = node.select(F.col("first").alias("shard"), F.posexplode("q").alias("source_no", "n"))
    w = Window.partitionBy("source_no").orderBy("shard")
    return (rows.withColumn("hi", F.sum("n").over(w).cast("long"))
            .select("source_no", "shard", (F.col("hi") - F.col("n")).cast("long").alias("lo"), "hi").where("n > 0"))


# one hypergeometric draw: x good of rest, need drawn.  Weights relative to the mode by the pmf's ratio.
_DRAW = """transform(array(named_struct(
    'lo', greatest(0D, a.need - (a.rest - e.x)), 'hi', least(e.x, a.need),
    'mode', floor((a.need + 1) * (e.x + 1) / (a.rest + 2)),
    'sd', sqrt(case when a.rest > 1 then a.need * (e.x / a.rest) * (1 - e.x / a.rest) * (a.rest - a.need) / (a.rest - 1) else 0D end),
    'u', cast(pmod(xxhash64(seed, e.i), 9007199254740992L) as double) / 9007199254740992D)), p ->
  case when p.lo >= p.hi then p.lo else
  transform(array(least(greatest(p.mode, p.lo), p.hi)), m ->
  transform(array(concat(
    reverse(aggregate(sequence(1, cast(least(ceil(12 * p.sd) + 12, m - p.lo) as int) + 1),
      named_struct('k', cast(m as double), 'w', 1D, 'out', cast(array() as array<struct<k: double, w: double>>)),
      (b, j) -> named_struct('k', b.k - 1,
        'w', b.w * b.k * (a.rest - e.x - a.need + b.k) / ((e.x - b.k + 1) * (a.need - b.k + 1)),
        'out', concat(b.out, array(named_struct('k', b.k, 'w', b.w)))), b -> b.out)),
    slice(aggregate(sequence(1, cast(least(ceil(12 * p.sd) + 12, p.hi - m) as int) + 1),
      named_struct('k', cast(m as double), 'w', 1D, 'out', cast(array() as array<struct<k: double, w: double>>)),
      (b, j) -> named_struct('k', b.k + 1,
        'w', b.w * (e.x - b.k) * (a.need - b.k) / ((b.k + 1) * (a.rest - e.x - a.need + b.k + 1)),
        'out', concat(b.out, array(named_struct('k', b.k, 'w', b.w)))), b -> b.out), 2, 2147483647))), ws ->
  aggregate(ws, named_struct('c', 0D, 'k', m, 'done', false, 'goal', p.u * aggregate(ws, 0D, (t, x) -> t + x.w)),
    (t, x) -> case when t.done then t else named_struct('c', t.c + x.w, 'k', x.k, 'done', t.c + x.w > t.goal, 'goal', t.goal) end,
    t -> t.k))[0])[0] end)[0]"""


def number_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per row of ``rows`` with ``r``, its number from 0 among the rows equal in all of ``keys``.

    Rows that repeat are counted inside each task, so a hot key is one row per task in the shuffle; the tasks'
    counts are offsets and every count is unfolded again.  ``rows`` has no column but ``keys``.
    """
    parts = rows.withColumn("p", F.spark_partition_id()).groupBy(*keys, "p").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("from", F.coalesce(F.sum("m").over(w), F.lit(0)))
    return parts.select(*keys, F.explode(F.sequence(F.col("from"), F.col("from") + F.col("m") - 1)).alias("r"))


def _beyond_first(r: str) -> Column:
    """``r`` as a further part of a hash; nothing for the first row of its kind."""
    return F.when(F.col(r) > 0, F.col(r))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", shards: int = SHARDS,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: text hash ``t``, number ``r`` among its repeats, size, source size, target, ``times`` it is taken, and the shard of each copy."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col("text")).alias("size"),
                       F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("t"))
    rows = materialize(number_repeats(rows, ["doc_id", "source", "t", "size"]), "mix_rows")
    rows = rows.withColumn("u", unit_hash("doc_id", "t", _beyond_first("r")))
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                                 .otherwise(F.lit(0.0)))
    sources = sources.withColumn("whole", F.floor(F.col("ratio")).cast("int"))
    sources = sources.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = sources.withColumn("blocks", F.ceil((F.col("source_size") + 1) / F.lit(float(block_words))).cast("long"))
    # sources as arrays in the tree are numbered in their order
    sources = materialize(sources.withColumn("source_no", (F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")), "mix_sources")
    n_sources = sources.count()

    def with_source(df, cols):
        s = sources.select(F.col("source").alias("__s"), *cols)
        return df.join(small_side(s, n_sources), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    placed = with_source(rows, ["source_no", "source_size", "target", "whole", "extra", "blocks"])
    placed = placed.withColumn("block", F.floor(F.col("u") / F.lit(float(1 << 52)) * F.col("blocks")).cast("long"))

    # prefix sums of block sizes in two levels: inside runs of 1,024 blocks, then over the runs
    blocks = materialize(placed.groupBy("source_no", "block").agg(F.sum("size").alias("words"),
                                                                  F.max("extra").alias("extra")), "mix_blocks")
    blocks = blocks.withColumn("run", F.floor(F.col("block") / _SUPER))
    runs = blocks.groupBy("source_no", "run").agg(F.sum("words").alias("run_words"))
    w = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("run_words").over(w), F.lit(0)))
    w = Window.partitionBy("source_no", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (blocks.withColumn("in_run", F.coalesce(F.sum("words").over(w), F.lit(0)))
              .join(runs.select("source_no", "run", "run_start"), ["source_no", "run"])
              .withColumn("start", F.col("run_start") + F.col("in_run"))
              .withColumn("extra_copy", F.when(F.col("start") + F.col("words") <= F.col("extra"), 2)
                          .when(F.col("start") < F.col("extra"), 1).otherwise(0)))   # 2 whole, 1 boundary, 0 none
    blocks = materialize(blocks.select("source_no", "block", "words", "start", "extra_copy", "extra"), "mix_prefix")

    # the boundary block of a source is cut at the document nearest to the target
    cut = (placed.select("source_no", "block", "doc_id", "t", "r", "u", "size")
           .join(blocks.where("extra_copy = 1").select("source_no", "block", "start", "extra"), ["source_no", "block"])
           .drop("block"))
    w = Window.partitionBy("source_no").orderBy("u", F.col("doc_id").asc_nulls_last(), "t", "r").rowsBetween(
        Window.unboundedPreceding, -1)
    cut = (cut.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(w), F.lit(0)))
           .where((F.col("at") + F.col("size") / 2 <= F.col("extra")) & (F.col("size") > 0))
           .select(F.col("source_no").alias("__c"), F.col("u").alias("__u"), F.col("doc_id").alias("__d"),
                   F.col("t").alias("__t"), F.col("r").alias("__r")))

    # block copies: whole passes first, then the extra one; copy = pass * blocks + block
    per = (blocks.groupBy("source_no").agg(F.max(F.when(F.col("extra_copy") > 0, F.col("block") + 1).otherwise(0))
                                           .alias("extra_blocks"))
           .join(sources.select("source_no", "whole", "blocks"), "source_no")
           .select("source_no", (F.col("whole") * F.col("blocks") + F.col("extra_blocks")).cast("double").alias("n")))
    quotas = per.agg(F.sort_array(F.collect_list(F.struct("source_no", "n"))).alias("s")).select(
        F.expr("transform(s, x -> x.n)").alias("q"))      # one entry per source
    shares = materialize(split_quotas(quotas, shards), "mix_shares")
    spans = shares.groupBy("source_no").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("spans"))

    out = placed.join(small_side(spans, n_sources), "source_no", "left")
    extra = blocks.select("source_no", "block", "extra_copy")
    out = out.join(small_side(extra), ["source_no", "block"], "left")
    cut_n = cut.count()
    out = out.join(small_side(cut, cut_n),
                   (F.col("source_no") == F.col("__c")) & (F.col("u") == F.col("__u"))
                   & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("t") == F.col("__t"))
                   & (F.col("r") == F.col("__r")), "left")
    # a copy counts when a shard drew its block copy; of the boundary block only documents before the cut have one
    out = out.withColumn("shards", F.when(F.col("size") > 0, F.expr("""
        filter(transform(filter(sequence(0, whole), t -> t < whole or extra_copy = 2 or __c is not null), t ->
          get(filter(spans, x -> t * blocks + block >= x.lo and t * blocks + block < x.hi), 0).shard),
          s -> s is not null)""")))
    out = out.withColumn("times", F.coalesce(F.array_size("shards"), F.lit(0)).cast("int"))
    out = out.withColumn("shards", F.when(F.col("times") > 0, F.col("shards")))
    return out.select("doc_id", "source", "t", "r", "size", "source_size", "target", "times",
                      (F.col("times") * F.col("size")).cast("long").alias("taken"), "shards")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed rows: every column of ``docs``, each row as often as the mix takes it.

    Rows come shard by shard, inside a shard in the order of a seeded hash.
    Every row is drawn by itself; rows of size 0 are not taken.
    """
    return place(docs, doc_id, source).orderBy("shard", "position").select("__row.*")


def place(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", shards: int = SHARDS,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per copy: ``__row`` with the columns of ``docs``, the ``shard`` that drew it, its ``position`` there."""
    m = materialize(mix(docs, doc_id, source, shards, block_words).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__src"), F.col("t").alias("__m"), F.col("r").alias("__no"),
        F.col("shards").alias("__shards")).where("__shards is not null or __no = 1"), "mix_copies")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(doc_id).alias("__a"),
                    F.col(source).alias("__b"), n_words(F.col("text")).alias("__n"), F.md5(F.col("text").cast("binary")).alias("__t"))
    d = d.where("__n > 0").drop("__n")
    repeated = m.where("__no = 1").select("__id", "__src", "__m")      # one row per kind that repeats
    n_repeated = repeated.count()
    if n_repeated:
        kind = F.col("__a").eqNullSafe(F.col("__id")) & F.col("__b").eqNullSafe(F.col("__src")) & (F.col("__t") == F.col("__m"))
        side = small_side(repeated, n_repeated)
        d = d.join(side, kind, "left_anti").withColumn("__r", F.lit(0).cast("long")).unionByName(
            _number_rows(d.join(side, kind, "left_semi"), [f"`__row`.`{c}`" for c in docs.columns]))
    else:
        d = d.withColumn("__r", F.lit(0).cast("long"))
    d = d.join(m.where("__shards is not null"), F.col("__a").eqNullSafe(F.col("__id")) & F.col("__b").eqNullSafe(F.col("__src"))
               & (F.col("__t") == F.col("__m")) & (F.col("__r") == F.col("__no")))
    d = d.select("__row", "__a", "__b", "__t", "__r", F.posexplode("__shards").alias("__copy", "shard"))
    return d.select("__row", "shard", unit_hash(F.lit("place"), "shard", "__copy", "__a", "__b", "__t",
                                                       _beyond_first("__r")).alias("position"))


def _number_rows(d: DataFrame, columns: list[str]) -> DataFrame:
    """Whole rows that repeat (__a, __b, __t), numbered in ``__r``: inside the piece of a task, after the earlier pieces."""
    keys = ["__a", "__b", "__t"]
    d = materialize(d.withColumn("__p", F.spark_partition_id()), "mix_repeats")
    parts = d.groupBy(*keys, "__p").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"{k}_") for k in [*keys, "__p"]], F.coalesce(F.sum("m").over(w), F.lit(0)).alias("__from"))
    inside = Window.partitionBy(*keys, "__p").orderBy(F.xxhash64(*columns))
    d = d.withColumn("__i", F.row_number().over(inside) - 1)
    d = d.join(parts, F.col("__a").eqNullSafe(F.col("__a_")) & F.col("__b").eqNullSafe(F.col("__b_"))
               & (F.col("__t") == F.col("__t_")) & (F.col("__p") == F.col("__p_")))
    return d.select("__row", *keys, (F.col("__from") + F.col("__i")).cast("long").alias("__r"))
