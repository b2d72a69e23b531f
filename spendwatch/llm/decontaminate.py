"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``WINDOW`` consecutive words of every benchmark
item (an item with fewer words is one shorter window).  For each window length
L, the shift table holds, for every block of B consecutive pattern words, its
least distance to the end of a pattern; a block that is not in it shifts by
L - B + 1.  A window covers L - B + 1 block positions, so only every
(L - B + 1)-th block of a document is looked up, all others being skipped; a
known block allows window ends from its shift onwards.  The suffix block's hash
of each possible end selects a bucket of windows, and the words themselves are
compared byte by byte.

Items are dealt by a hash to blocks of about ``ITEM_WORDS`` words, a long item
in pieces that overlap by a window less one word.  Tasks build the tables of the
blocks, one block each, and write them to a stage.  A block is one broadcast of
bounded size and one pass over the documents, so a large benchmark makes more
passes, never a larger table: the driver holds one block at a time.  With
several blocks each pass is a job of its own that writes the occurrences it
found, by text; at the end these are merged by text and joined back, so the plan
is as deep for fifty blocks as for two.

Defined cases: a null or empty text has no words and no hits; an item without
words matches nothing; an item whose id is null marks words as hit but adds no
id; repeated items count once by id; repeated documents are separate rows; an
empty benchmark or document table gives no hits or no rows; all columns of the
documents are carried, whatever their names.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .words import ALNUM, Words, chunks

WINDOW = 10
BLOCK = 3
ITEM_WORDS = 300_000


def spelled(raw: bytes, w: Words, p: int, length: int) -> bytes:
    """The ``length`` words from position ``p``, parted by spaces, which no word holds."""
    return b" ".join(raw[s:e] for s, e in zip(w.start[p:p + length].tolist(), w.end[p:p + length].tolist()))


class Patterns:
    """Tables of one block of items, by window length."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.ids: list[str | None] = [i for i, _ in items]
        self.tables: list[tuple] = []
        column = pa.array([t for _, t in items], pa.large_string())
        found: dict[int, dict[bytes, set]] = {}
        hashes: dict[int, dict[bytes, tuple]] = {}
        for first, _, data, bounds in chunks(column):
            w = Words(data, bounds, ALNUM)
            raw = w.low.tobytes()
            for d in range(w.n_docs):
                a, b = int(w.first[d]), int(w.first[d + 1])
                length = min(window, b - a)
                if not length:
                    continue
                for p in range(a, b - length + 1):
                    words = spelled(raw, w, p, length)
                    found.setdefault(length, {}).setdefault(words, set()).add(first + d)
                    if words not in hashes.setdefault(length, {}):
                        size = min(BLOCK, length)
                        at = np.arange(p, p + length - size + 1)
                        hashes[length][words] = tuple(w.window(at, size).tolist())
        for length, windows in found.items():
            size = min(BLOCK, length)
            shift: dict[int, int] = {}
            for words in windows:
                row = hashes[length][words]
                for back, h in enumerate(reversed(row)):
                    shift[h] = min(back, shift.get(h, length))
            block = np.array(sorted(shift), np.uint64)
            listed = sorted(windows, key=lambda x: hashes[length][x][-1])
            self.tables.append((length, size, block, np.array([shift[h] for h in block.tolist()], np.int64),
                                np.array([hashes[length][x][-1] for x in listed], np.uint64), listed,
                                [sorted(windows[x]) for x in listed]))

    def search(self, w: Words) -> list[tuple[int, int, list[int]]]:
        """(word position, window length, items) of every occurrence in a chunk."""
        out, n = [], len(w.hash)
        raw = None
        for length, size, block, shift, suffix, listed, items in self.tables:
            step = length - size + 1
            at = np.arange(0, n - size + 1, step) if n >= size else np.zeros(0, np.int64)
            h = w.window(at, size)
            k = np.minimum(np.searchsorted(block, h), len(block) - 1)
            known = block[k] == h
            at, least = at[known], shift[k[known]]
            starts = [(at + size + d - length)[least <= d] for d in range(step)]
            start = np.unique(np.concatenate(starts)) if starts else at
            start = start[(start >= 0) & (start + length <= n)]
            start = start[w.doc[start] == w.doc[start + length - 1]]
            tail = w.window(start + length - size, size)
            lo, hi = np.searchsorted(suffix, tail, "left"), np.searchsorted(suffix, tail, "right")
            for p, a, b in zip(start[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                raw = raw if raw is not None else w.low.tobytes()
                words = spelled(raw, w, p, length)
                for k in range(a, b):
                    if listed[k] == words:
                        out.append((p, length, items[k]))
        return out


def _pieces(size: int, window: int):
    """Items as pieces of at most ``size`` words that hold every window between them: id, text, words."""
    def run(batches):
        for b in batches:
            for first, end, data, bounds in chunks(b.column(1)):
                w = Words(data, bounds, ALNUM)
                raw, ids, texts, words = w.low.tobytes(), [], [], []
                for i, key in enumerate(b.column(0).slice(first, end - first).to_pylist()):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    at = lo
                    while at < hi:
                        to = min(at + size, hi)
                        ids.append(key)
                        texts.append(raw[w.start[at]:w.end[to - 1]])
                        words.append(to - at)
                        at = hi if to == hi else to - window + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words, pa.int64())],
                    names=["i", "t", "n"])
    return run


def pattern_tables(benchmark: DataFrame, window: int = WINDOW, item_words: int = ITEM_WORDS) -> tuple[DataFrame, int]:
    """(block, its pickled tables), built by one task per block and staged, and the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    pieces = materialize(items.where("t is not null").dropDuplicates().mapInArrow(
        _pieces(max(item_words // 8, 4 * window), window), "i string, t string, n long"), "pieces")
    n_blocks = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // item_words)

    def build(key, table):
        found = Patterns(list(zip(table.column("i").to_pylist(), table.column("t").to_pylist())), window)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "tables": pa.array([pickle.dumps(found, 5)], pa.binary())})

    block = F.pmod(F.xxhash64("i", "t"), F.lit(max(n_blocks, 1))).cast("int").alias("block")
    built = pieces.select(block, "i", "t").groupBy("block").applyInArrow(build, "block int, tables binary")
    return materialize(built, "patterns"), n_blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  item_words: int = ITEM_WORDS) -> DataFrame:
    """All columns of ``docs`` (as c0, c1, ...) with n_words, n_hit, spans (start, length of each
    occurrence, in words) and items (sorted ids of the items with an occurrence)."""
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")
    none = {"spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    plain = docs.toDF(*names)
    tables, n_blocks = pattern_tables(benchmark, window, item_words)

    def search(rows: DataFrame, block: int, at: int) -> DataFrame:
        one = tables.where(F.col("block") == block).first()
        patterns = spark.sparkContext.broadcast(pickle.loads(one.tables) if one else Patterns([], window))
        rows = rows.withColumns(none)
        return rows.mapInArrow(_searcher(patterns, at, len(rows.columns) - 2), rows.schema)

    if n_blocks <= 1:
        out = search(plain, 0, text) if n_blocks else plain.withColumns(none)
    else:
        # what is found depends on the text alone: occurrences are kept by text, and only for texts that have some
        key = F.sha2(F.col(f"c{text}").cast("string"), 256)
        texts = plain.where(F.col(f"c{text}").isNotNull()).select(key.alias("k"), F.col(f"c{text}").alias("t"))
        found = [materialize(search(texts, k, 1).where(F.size("spans") > 0).select("k", "spans", "items")
                             .dropDuplicates(["k"]), "occurrences") for k in range(n_blocks)]
        merged = reduce(DataFrame.unionAll, found).groupBy("k").agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = plain.withColumn("k", key).join(merged, "k", "left").select(
            *names, *[F.coalesce(F.col(c), v).alias(c) for c, v in none.items()])
    schema = T.StructType([*[f for f in out.schema.fields if f.name not in ("spans", "items")],
                           T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                           *[f for f in out.schema.fields if f.name in ("spans", "items")]])
    return out.mapInArrow(_counter(text, len(names)), schema)


def _searcher(patterns, text: int, n_cols: int):
    def run(batches):
        for b in batches:
            spans = b.column(n_cols).to_pylist()
            items = b.column(n_cols + 1).to_pylist()
            for first, _, data, bounds in chunks(b.column(text)):
                w = Words(data, bounds, ALNUM)
                for p, length, found in patterns.value.search(w):
                    d = int(w.doc[p])
                    spans[first + d] += [p - int(w.first[d]), length]
                    items[first + d] += [i for k in found if (i := patterns.value.ids[k]) is not None]
            cols = [*b.columns[:n_cols], pa.array(spans, pa.list_(pa.int32())),
                    pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
    return run


def _counter(text: int, n_cols: int):
    def run(batches):
        for b in batches:
            words = np.zeros(b.num_rows, np.int64)
            for first, end, data, bounds in chunks(b.column(text)):
                words[first:end] = _word_counts(data, bounds)
            hit = [_covered(s) for s in b.column(n_cols).to_pylist()]
            cols = [*b.columns[:n_cols], pa.array(words), pa.array(hit, pa.int64()), *b.columns[n_cols:]]
            yield pa.RecordBatch.from_arrays(
                cols, names=[*b.schema.names[:n_cols], "n_words", "n_hit", *b.schema.names[n_cols:]])
    return run


def _word_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    inside = ALNUM[data]
    inside |= (data >= 65) & (data <= 90)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[1:] > bounds[:-1]]
    begin[firsts] = inside[firsts]
    return np.diff(np.concatenate([[0], np.cumsum(begin)])[bounds])


def _covered(spans: list[int]) -> int:
    n, last = 0, 0
    for a, length in sorted(zip(spans[::2], spans[1::2])):
        n += max(0, a + length - max(a, last))
        last = max(last, a + length)
    return n
