"""Audit of how quality filters interact: every order of them, over every part of the corpus.

A document's failing filters are the bits of a mask.  The documents of one
part and mask are one weighted cell, so the corpus is reduced to at most 32
cells a part before anything is tried.  Each cell then folds across the array
of all orders, a constant of the plan: ``transform`` over the orders and
``aggregate`` along one order give a struct of weighted counts for every order
and step, 600 for five filters.  The arrays of a part's cells are merged by
elementwise sums.  No document is read again for an order.

The copies filter needs the smallest doc_id of every text.  Texts are compared
by SHA-256; the minima are grouped map-side, and only texts that occur more
than once join back, one narrow row each, so a text that very many documents
share is a split side of the join.

Defined cases: a null text is empty; a null language is the empty string, and
is one part with documents whose language is the empty string; a null doc_id is
smaller than none and has none smaller, so such a document is no copy and makes
none, and has no labels; rows that repeat a doc_id and text are no copies of
each other; a document is good or toxic if any of its label rows says so; a
very long text is one array of words inside its task; an empty table has no
parts and no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TRIM, WORD_GAP, materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

# the audited thresholds
MIN_WORDS = 100            # A: fewer words fail
MIN_DISTINCT_PCT = 80      # B: a smaller share of distinct words fails
MAX_CAPITAL_PCT = 10       # C: a larger share of capitals fails
SYMBOLS = "[#$%&*|]"       # D: any of these fails


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which look at one text only."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.trim(text, F.lit(TRIM))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))
    n = F.size(words).cast("long")
    few = n < MIN_WORDS
    poor = 100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT_PCT * n
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITAL_PCT * F.length(text).cast("long")
    marks = text.rlike(SYMBOLS)
    return sum((F.when(c, F.lit(BIT[f])).otherwise(F.lit(0)) for f, c in zip("ABCD", (few, poor, loud, marks))), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every document."""
    text = F.col("text").cast("string")
    own = materialize(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                                  text_mask(text).alias("m"),
                                  F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("h")), "audit_masks")
    first = (own.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("h").alias("k"), "least"))
    marked = (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
              .agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
                   F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return (own.join(first, F.col("h") == F.col("k"), "left")
            .join(marked, F.col("doc_id") == F.col("id"), "left")
            .select("doc_id", "part", F.when(copy, F.col("m") + BIT["E"]).otherwise(F.col("m")).alias("mask"),
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


# one cell along one order: s.seen holds the bits applied so far, s.steps what each step does to the cell
_FOLD = """
transform(orders, o -> aggregate(o, named_struct('seen', 0, 'steps', cast(array() as array<struct<{fields}>>)),
  (s, b) -> named_struct('seen', s.seen | b, 'steps', concat(s.steps, array(named_struct(
    'kept', if(mask & (s.seen | b) = 0, n, 0L),
    'removed', if(mask & b <> 0 and mask & s.seen = 0, n, 0L),
    'redundant', if(mask & b <> 0 and mask & s.seen <> 0, n, 0L),
    'unique_fails', if(mask = b, n, 0L),
    'good_lost', if(mask & b <> 0 and mask & s.seen = 0, n_good, 0L),
    'toxic_lost', if(mask & b <> 0 and mask & s.seen = 0, n_toxic, 0L))))),
  s -> s.steps))""".format(fields=", ".join(f"{c}: bigint" for c in COUNTS))

# the same step of every cell, added up
_MERGE = "aggregate(slice(cells, 2, size(cells)), cells[0], (a, x) -> zip_with(a, x, (p, q) -> named_struct({sums})))".format(
    sums=", ".join(f"'{c}', p.{c} + q.{c}" for c in COUNTS))


def _orders_sql(of) -> str:
    return "array(" + ", ".join(of(o) for o in ORDERS) + ")"


def audit(cells: DataFrame) -> DataFrame:
    """Counts of every part, order and step from (part, mask, n, n_good, n_toxic) cells, a part and mask once."""
    orders = _orders_sql(lambda o: "array(" + ", ".join(str(BIT[f]) for f in o) + ")")
    folded = cells.withColumn("orders", F.expr(orders)).select("part", F.flatten(F.expr(_FOLD)).alias("steps"))
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", F.expr(_MERGE).alias("steps"))
    of_letter = "aggregate(transform(steps, (x, i) -> if(bits[i] = {b}, x.removed, 0L)), 0L, (a, x) -> a + x)"
    total = F.array(*[F.expr(of_letter.format(b=BIT[f])) for f in FILTERS])
    merged = (merged.withColumn("bits", F.flatten(F.expr(orders))).withColumn("shapley", total)
              .select("part", "shapley", F.posexplode("steps").alias("at", "c")))
    k = len(FILTERS)
    order = F.element_at(F.expr(_orders_sql(lambda o: f"'{o}'")), F.expr(f"at div {k} + 1").cast("int"))
    rows = merged.select("part", order.alias("filter_order"), (F.col("at") % k + 1).cast("int").alias("step"), "c.*", "shapley")
    letter = F.expr(f"locate(substring(filter_order, step, 1), '{FILTERS}')")
    return rows.withColumn("shapley", F.element_at("shapley", letter))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    cells = masks(docs, labels).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("n_good"),
        F.sum(F.col("toxic").cast("long")).alias("n_toxic"))
    return audit(cells)
