"""N-gram Jaccard join by parity sketches.

Two shingle sets with Jaccard similarity of at least t differ in at most
d = (1 - t) / (1 + t) * (|A| + |B|) shingles, and the larger is at most 1 / t
times the smaller.  Sizes fall into bands [lo, lo / t]; a set joins its own
band and, as the smaller side, the next one.  Within a band a sketch XORs the
hash of every shingle into one of p = d + r pieces.  A differing shingle
touches one piece, so linked sets agree in r pieces at least (pigeonhole).
r is chosen above the usual number of empty pieces, for the band's sets and for
the smaller ones that join it, so linked sets agree in a
piece with content; those pieces become join keys.  A set with r or more empty
pieces is dealt out anew with the next seed as well; two linked sets that share
no key in one seed both do so, hence no link is lost.

A piece whose shingles are all common (found in several texts of a bounded
sample) would tie texts that only share a passage.  A set with fewer than r
such or empty pieces leaves them out: of r agreeing pieces one is left, and its
partner has the same piece.  Any other set sends all its pieces.  The sample
only decides which keys are sent, never which links are found.

Equal sets are one class throughout.  Keys are made and joined in up to ``PASSES``
passes, each for the keys of one residue, so that only a part of them lies on
disk at a time and a task sorts a bounded number of them.

One shared key is no candidate yet: texts that only share a passage meet in a
key now and then, and in a large table such pairs would tie nearly all sets to
one group.  A set that leaves out u < r pieces (empty, or all common) shares
r - u keys at least with each set it is linked with; of two sets that send all
pieces each shares r - e with the other, e being its empty ones.  So the pairs of
a key are counted, and fewer shared keys than promised, in every seed, rule a pair out.  A
key of more than ``PAIRED`` classes forms no pairs; a set's promise is less by
the keys of this kind it has.  Sets whose promise comes to nothing are open: one
key ties them to each other, those of many classes too.

The candidate pairs' components are the candidate groups; within a group, bit sketches (one bit flipped per shingle)
give Hamming distances, which never exceed the symmetric difference, and pairs
within the bound are verified on the shingles themselves.  A large group is cut
by size and into blocks: blocks are joined within themselves, then only sets outside the
group's largest linked component meet the other blocks.  Only spanning links
leave a task, never all pairs.

A class is verified on one text, the row with the smallest id and text hash.
Rows that repeat both are reduced inside each task before they move, and a
verifier skips those that come from several tasks, so their number neither
fills a task's memory nor makes a group large.

Result: classes by links.  Defined cases: no text or no words gives an empty
set, linked with nothing; repeated rows and rows with a null doc_id are rows of
their class (a class of null ids has a null component id); very long texts are
one set; an empty table gives an empty result; other columns are ignored, or
carried by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_side
from .components import connected_components
from .words import SPACED, Words, chunks, give_back, mix, shingle_sets

BLOCK_SETS = 1024            # sets of a block
BLOCK_SHINGLES = 1_500_000   # shingles of a block
SEEDS = 16
SAMPLE, COMMON = 20_000, 2   # texts of the sample, and how many of them make a shingle common
KEYS_AT_ONCE = 300_000     # keys among which a task drops repeats before it sends them
PAIRED = 16                # classes of a key up to which its pairs are counted
PLAIN, NEED = 1024, 2048   # a tag is level * NEED, + PLAIN where a set sends all its pieces, + promised keys below PLAIN
PASSES = 4                 # passes over the texts in which keys are made and joined
PASS_SHINGLES = 2_000_000  # shingles of all texts below which one pass is enough
TASK_SHINGLES = 2_000_000  # shingles whose keys one task joins in a pass
_U = np.uint64


class Bands:
    """Size bands of a similarity ``num / den``: lower bounds, pieces and spare pieces."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lo, self.pieces, self.spare = [1], [], []

    def reach(self, n: int) -> None:
        """Bands up to the one above size ``n``."""
        while len(self.pieces) < 2 or self.lo[-3] <= n:
            lo = self.lo[-1]
            hi = lo * self.den // self.num
            d = self.bound(hi, hi)
            p, r = d + 2, 2
            for _ in range(4):
                # of sets of the band, and of the smallest ones that join it from the band below
                empty, more = p * math.exp(-lo / p), p * math.exp(-lo * self.num / self.den / p)
                r = 1 + math.ceil(max(empty + 4 * math.sqrt(empty), more + 2 * math.sqrt(more)))
                p = d + r
            self.pieces.append(p if d else 0)
            self.spare.append(r)
            self.lo.append(hi + 1)

    def bound(self, n: int, m: int) -> int:
        """Largest symmetric difference of linked sets of sizes ``n`` and ``m``."""
        return (self.den - self.num) * (n + m) // (self.den + self.num)


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit value per set from its shingles and size (0: the empty set)."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(sets ^ _U(0x51ED270B7A53)), dtype=_U)])
    n = np.diff(bounds).astype(_U)
    out = mix(sums[bounds[1:]] - sums[bounds[:-1]] + n * _U(0x9E3779B97F4A7C15))
    return np.where(n == 0, _U(0), np.where(out == 0, _U(1), out))


def join_keys(sets: np.ndarray, bounds: np.ndarray, ids: np.ndarray, bands: Bands,
              common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) of the pieces of the sets' sketches; ``common`` are sorted shingles that many texts have."""
    return level_keys(sets, bounds, ids, bands, common)[:2]


def level_keys(sets: np.ndarray, bounds: np.ndarray, ids: np.ndarray, bands: Bands,
               common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``join_keys`` and the tag of each: its level (band and seed), whether the set sends all its pieces, its promise."""
    sizes = np.diff(bounds)
    bands.reach(int(sizes.max(initial=0)))
    lo, pieces, spare = (np.array(x, np.int64) for x in (bands.lo, bands.pieces, bands.spare))
    rare = np.ones(len(sets), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, sets), len(common) - 1)] != sets
    own = np.searchsorted(lo, sizes, side="right") - 1
    keys, owners, tags = [], [], []
    for band in (own, own + 1):
        active = (sizes > 0) & (pieces[np.maximum(band, 0)] > 0)
        active &= (band == own) | (sizes * bands.den >= lo[np.maximum(band, 0)] * bands.num)
        for seed in range(SEEDS):
            rows = np.flatnonzero(active)
            if not len(rows):
                break
            n = sizes[rows]
            at = np.repeat(bounds[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            h = sets[at]
            p = pieces[band[rows]]
            base = np.cumsum(p) - p
            part = mix(h ^ mix(np.full(1, seed + 1, _U))) % np.repeat(p, n).astype(_U)
            cell = np.repeat(base, n) + part.astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            value = np.bitwise_xor.reduceat(h[order], begin)
            filled = cell[begin]
            row = np.searchsorted(base, filled, side="right") - 1
            few = p - np.bincount(row, minlength=len(rows))
            telling = np.logical_or.reduceat(rare[at][order], begin)
            need = spare[band[rows]] - (p - np.bincount(row[telling], minlength=len(rows)))
            plain = need <= 0
            sent = telling | plain[row]
            tag_of = (band[rows] * SEEDS + seed) * NEED + plain * PLAIN
            tag_of += np.clip(np.where(plain, spare[band[rows]] - few, need), 0, PLAIN - 1)
            value, filled, row = value[sent], filled[sent], row[sent]
            tag = (band[rows][row] * SEEDS + seed).astype(_U) * _U(0xD6E8FEB86659FD93) + (filled - base[row]).astype(_U)
            keys.append(mix(value + mix(tag)))
            owners.append(ids[rows][row])
            tags.append(tag_of[row].astype(np.int32))
            active = np.zeros(len(sizes), bool)
            active[rows[few >= spare[band[rows]]]] = True
        rest = np.flatnonzero(active)             # empty pieces in every seed: one key for all of the band
        keys.append(mix(band[rest].astype(_U) + _U(0x7F4A7C159E3779B9)))
        owners.append(ids[rest])
        tags.append(((band[rest] * SEEDS + SEEDS - 1) * NEED + PLAIN).astype(np.int32))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(tags)


def _set_rows(k: int):
    def run(batches):
        for b in batches:
            n, ids = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, _U)
            for first, end, data, bounds in chunks(b.column(2)):
                sets, at = shingle_sets(Words(data, bounds, SPACED), k)
                n[first:end], ids[first:end] = np.diff(at), fingerprints(sets, at)
            cols = [b.column(0), b.column(1), pa.array(n), pa.array(ids.view(np.int64), mask=ids == 0)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n", "fp"])
        give_back()
    return run


def common_shingles(d: DataFrame, rows: int, k: int) -> np.ndarray:
    """Sorted shingles found in ``COMMON`` or more texts of a sample of about ``SAMPLE`` of the ``rows`` texts."""
    share = min(1.0, SAMPLE / max(rows, 1))
    sample = d.where(F.pmod(F.xxhash64("th"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("text")

    def run(batches):
        for b in batches:
            for _, _, data, bounds in chunks(b.column(0)):
                sets, _ = shingle_sets(Words(data, bounds, SPACED), k)
                yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64))], names=["s"])
        give_back()

    # at most 1 / COMMON of the sample's shingles, whatever the table
    found = sample.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= COMMON).select("s")
    return np.sort(found.toArrow().column(0).to_numpy().view(_U))


def _key_rows(k: int, num: int, den: int, common, at: int = 0, passes: int = 1):
    """Keys of pass ``at`` of ``passes``, those of one residue; equal sets of a batch of keys send theirs once."""
    def rows(keys, ids, tags):
        keys, ids, tags = np.concatenate(keys), np.concatenate(ids), np.concatenate(tags)
        order = np.lexsort((ids, keys))
        keys, ids, tags = keys[order], ids[order], tags[order]
        first = _new(keys) | _new(ids)
        cols = [pa.array(keys[first].view(np.int64)), pa.array(ids[first].view(np.int64)), pa.array(tags[first])]
        return pa.RecordBatch.from_arrays(cols, names=["key", "id", "tag"])

    def run(batches):
        bands = Bands(num, den)
        frequent = common.value if common is not None else None
        keys, ids, tags, n = [], [], [], 0
        for b in batches:
            for _, _, data, bounds in chunks(b.column(0)):
                sets, ends = shingle_sets(Words(data, bounds, SPACED), k)
                key, own, tag = level_keys(sets, ends, fingerprints(sets, ends), bands, frequent)
                now = key % _U(passes) == _U(at)
                keys.append(key[now])
                ids.append(own[now])
                tags.append(tag[now])
                n += len(keys[-1])
                if n > KEYS_AT_ONCE:
                    yield rows(keys, ids, tags)
                    keys, ids, tags, n = [], [], [], 0
        if keys:
            yield rows(keys, ids, tags)
        del keys, ids, tags
        give_back()
    return run


def _new(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _pair_rows(paired: int):
    """Pairs (a, b, tag_a, tag_b) of the classes of each key, from (key, id, tag) sorted by key and id.

    The classes of a key that has more than ``paired`` come each as (id, key, tag, -1).  At most ``paired`` rows
    of a key are held from one batch to the next.
    """
    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        hot = None                                    # (key, id) of the last row, of a key of too many classes

        def rows(a, b, tag_a, tag_b):
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, tag_a, tag_b)]
            cols = [pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "tag_a", "tag_b"])

        def found(key, i, tag, begin, size):
            """Rows of whole groups, and of the groups of keys known to have too many classes."""
            a, b, tag_a, tag_b = [], [], [], []
            many = size > paired
            if hot is not None and len(begin):
                many[0] |= key[begin[0]] == hot[0]
            if many.any():
                at = np.flatnonzero(np.repeat(many, size))
                a, b, tag_a, tag_b = [i[at]], [key[at]], [tag[at]], [np.full(len(at), -1, np.int32)]
            for n in np.unique(size[~many & (size > 1)]).tolist():
                x, y = np.triu_indices(n, 1)
                at = begin[~many & (size == n)][:, None]
                x, y = (at + x).ravel(), (at + y).ravel()
                a.append(i[x])
                b.append(i[y])
                tag_a.append(tag[x])
                tag_b.append(tag[y])
            return rows(a, b, tag_a, tag_b)

        for batch in batches:
            key, i, tag = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
            first = _new(key) | _new(i)
            if hot is not None and len(key):
                first[0] = (key[0], i[0]) != hot
            key, i, tag = key[first], i[first], tag[first]
            if not len(key):
                continue
            begin = np.flatnonzero(_new(key))
            size = np.diff(np.append(begin, len(key)))
            if size[-1] > paired or hot is not None and key[-1] == hot[0]:
                held = [x[:0] for x in held]
                now = (key[-1], i[-1])
            else:
                held, now = [x[begin[-1]:] for x in (key, i, tag)], None
                begin, size = begin[:-1], size[:-1]
                key, i, tag = (x[:len(x) - len(held[0])] for x in (key, i, tag))
            yield found(key, i, tag, begin, size)
            hot = now
        key, i, tag = held
        if len(key):
            yield found(key, i, tag, np.zeros(1, np.int64), np.array([len(key)]))
        give_back()
    return run


def verify(sets: list[np.ndarray], pairs_of, bands: Bands, label: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links among ``sets``: for each set i the candidates ``pairs_of(i)`` with another label.

    ``label`` is updated; sets with one label are known to be connected.
    """
    n = np.array([len(s) for s in sets], np.int64)
    width = max(1, -(-int(n.max(initial=1)) // 8))
    sketch = np.zeros((len(sets), width), _U)
    for i, s in enumerate(sets):
        bits = np.bincount((s % _U(width * 64)).astype(np.int64), minlength=width * 64) & 1
        sketch[i] = np.packbits(bits.astype(np.uint8), bitorder="little").view(_U)
    out = []
    for i in range(len(sets)):
        j = pairs_of(i)
        j = j[label[j] != label[i]]
        j = j[np.minimum(n[j], n[i]) * bands.den >= np.maximum(n[j], n[i]) * bands.num]
        if not len(j):
            continue
        far = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64)
        for c in j[far <= (bands.den - bands.num) * (n[j] + n[i]) // (bands.den + bands.num)].tolist():
            if label[c] == label[i]:
                continue
            a, b = (sets[c], sets[i]) if n[c] <= n[i] else (sets[i], sets[c])
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int((b[at] == a).sum())
            if both * bands.den >= (len(a) + len(b) - both) * bands.num:
                out.append((c, i))
                label[label == max(label[c], label[i])] = min(label[c], label[i])
    return out


def _verifier(k: int, num: int, den: int):
    """Links of rows that arrive sorted by their group columns; one group is held at a time.

    Columns: g1, g2, g3 (group), side, label, id, text.  Rows of side 0 meet those of side 1, or each
    other where the group has no side 1; a set that is on both sides is in both roles.
    """
    def links(group, bands):
        at: dict = {}
        strip, block, labels, sets = [], [], [], []
        for side, label, i, text in group:
            if i not in at:
                at[i] = len(at)
                sets.append(np.concatenate([shingle_sets(Words(data, bounds, SPACED), k)[0]
                                            for _, _, data, bounds in chunks(pa.array([text]))]))
                labels.append(label)
                strip.append(False)
                block.append(False)
            (block if side else strip)[at[i]] = True
        ids = list(at)
        label = np.unique(np.array(labels, np.int64), return_inverse=True)[1]
        every, probe = np.arange(len(ids)), np.flatnonzero(block)
        if len(probe):
            found = verify(sets, lambda i: probe if strip[i] else every[:0], bands, label)
        else:
            found = verify(sets, lambda i: every[:i], bands, label)
            if found:                            # as stars: each set with the smallest id of its component
                order = np.argsort(np.array(ids))
                least = np.full(len(ids), -1)
                for i in order[::-1].tolist():
                    least[label[i]] = i
                found = [(least[label[i]], i) for i in range(len(ids)) if least[label[i]] != i]
        return [(ids[a], ids[b]) for a, b in found]

    def run(batches):
        bands = Bands(num, den)
        now, last, group = None, None, []
        out: list[tuple[int, int]] = []
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                for *key, side, label, i, text in zip(*[c.slice(lo, 500).to_pylist() for c in b.columns]):
                    if key != now:
                        if len(group) > 1:
                            out += links(group, bands)
                        now, last, group = key, None, []
                    if (side, i) != last:             # else one more row of the same id and text
                        last = (side, i)
                        group.append((side, label, i, text))
            yield _edges(out)
            out = []
        if len(group) > 1:
            out += links(group, bands)
        yield _edges(out)
        group.clear()
        give_back()
    return run


def _edges(pairs) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _first_rows(batches):
    """The rows of a task without those that repeat an earlier row's (doc_id, text hash): the first two columns.

    Ids and hashes of one task's rows are held, no texts.
    """
    seen: set = set()
    for b in batches:
        keep = []
        for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield b if len(keep) == b.num_rows else b.take(pa.array(keep, pa.int64()))


def _repeats(rows: DataFrame) -> bool:
    """Whether any (doc_id, th) is found twice; then rows are reduced inside their tasks before they are shuffled."""
    return rows.groupBy("doc_id", "th").count().where("count > 1").limit(1).count() > 0


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text hash ``th``, n_shingles, class ``fp`` and component_id.

    Documents link when den * |A and B| >= num * |A or B| over their ``k``-word shingles.
    """
    return _components(docs, k, num, den, doc_id).drop("c")


def _met(texts: DataFrame, shingles: int, k: int, num: int, den: int, common) -> DataFrame:
    """(a, b): candidate pairs of classes, and links that tie the classes of keys that tell nothing.

    A pass is written before the next one begins, and Spark drops its shuffle files.
    """
    spark = texts.sparkSession
    passes = max(1, min(PASSES, shingles // PASS_SHINGLES))
    tasks = -(-shingles // (passes * TASK_SHINGLES))
    out = None
    for at in range(passes):
        keys = texts.mapInArrow(_key_rows(k, num, den, common, at, passes), "key long, id long, tag int")
        many = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = keys.repartition(tasks, "key") if many else keys.repartition("key")
        met = keys.sortWithinPartitions("key", "id").mapInArrow(_pair_rows(PAIRED), "a long, b long, tag_a int, tag_b int")
        met = materialize(met.groupBy("a", "b", "tag_a", "tag_b").agg(F.count("*").alias("shared")), "met")
        out = met if out is None else out.unionByName(met)
        del keys, met
        release(spark)
    edges = materialize(_candidates(out), "candidates")
    release(spark)
    return edges


def _candidates(met: DataFrame) -> DataFrame:
    """(a, b): the pairs of ``met`` that share as many keys as either set promises, and ties of open sets."""
    def promised(side):
        return F.pmod(F.col(f"tag_{side}"), F.lit(PLAIN)) - F.coalesce(F.col(f"lost_{side}"), F.lit(0))

    def plain(side):
        return F.pmod(F.col(f"tag_{side}"), F.lit(NEED)) >= PLAIN

    hot = met.where("tag_b = -1").select("a", F.col("b").alias("key"), "tag_a")
    lost = materialize(hot.groupBy("a", "tag_a").agg(F.count("*").alias("lost_a")), "lost")
    pairs = met.where("tag_b <> -1").groupBy("a", "b", "tag_a", "tag_b").agg(F.sum("shared").alias("shared"))
    pairs = pairs.join(lost, ["a", "tag_a"], "left").join(
        lost.select(F.col("a").alias("b"), F.col("tag_a").alias("tag_b"), F.col("lost_a").alias("lost_b")), ["b", "tag_b"], "left")
    # what a set that sends all its pieces promises holds for another such set only
    least = [F.when(plain(x) & ~plain(y), 0).otherwise(promised(x)) for x, y in ("ab", "ba")]
    pairs = pairs.where(F.col("shared") >= F.greatest(*least)).select("a", "b")

    # an open set that left pieces out is tied to all sets of the key that are open or sent all of theirs
    ties = hot.join(lost, ["a", "tag_a"]).select("key", "a", (promised("a") <= 0).alias("open"), plain("a").alias("plain"))
    ties = materialize(ties.where("open or plain"), "open")
    key = ties.groupBy("key").agg(F.max(F.expr("open and not plain")).alias("every"), F.min("a").alias("first"),
                                  F.min(F.when(F.col("open"), F.col("a"))).alias("first_open"))
    ties = ties.join(key, "key").where("open or every").select("a", F.expr("if(every, first, first_open)").alias("b"))
    return pairs.unionByName(ties.where("a <> b")).distinct()


def _components(docs: DataFrame, k: int, num: int, den: int, doc_id: str) -> DataFrame:
    """The rows of ``jaccard_components`` with ``c``, the class that names the component (null without words).

    ``component_id`` is for readers: components share one where an id is null or repeated, ``c`` never.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = materialize(d.mapInArrow(_set_rows(k), f"doc_id {kind}, th long, n long, fp long"), "sets")
    classes = materialize(rows.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "th")).alias("rep"), F.max("n").alias("n")), "classes")

    common = docs.sparkSession.sparkContext.broadcast(common_shingles(d, rows.count(), k))
    groups = connected_components(_met(d.select("text"), rows.agg(F.sum("n")).first()[0] or 0, k, num, den, common))
    member = materialize(groups.join(classes, F.col("node") == F.col("fp")).select(
        F.col("component").alias("g"), "fp", "rep", "n"), "members")
    release(docs.sparkSession)

    # blocks of a group; most groups are one block.  A larger one is split by size first: a set joins
    # its own size band and the next, so sets of very different sizes never meet
    def with_blocks(df):
        sizes = df.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
        blocks = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("s") / BLOCK_SHINGLES)).cast("int")
        return df.join(sizes.select("g", blocks.alias("blocks")), "g")

    member = materialize(with_blocks(member), "groups")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0001 * math.log(den / num)))
    split = member.where("blocks > 1").select(
        F.explode(F.array(band, band + 1)).alias("b"), F.col("g").alias("whole"), "fp", "rep", "n").select(
        F.xxhash64("whole", "b").alias("g"), "fp", "rep", "n")
    member = member.where("blocks = 1").unionByName(with_blocks(split).select(member.columns))
    member = materialize(member.select("*", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block")), "blocks")
    if _repeats(rows):
        d = d.mapInArrow(_first_rows, d.schema)
    wanted = member.select(F.col("rep.doc_id").alias("__id"), F.col("rep.th").alias("__th"), "g", "fp", "blocks", "block")
    # texts move once, to their group's row, whatever the number of groups
    texts = d.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))

    def linked(parts):
        parts = parts.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "id")
        return parts.mapInArrow(_verifier(k, num, den), "a long, b long")

    links = materialize(linked(texts.select(
        F.col("g").alias("g1"), F.col("block").alias("g2"), F.lit(0).alias("g3"), F.lit(0).alias("side"),
        F.col("fp").alias("label"), F.col("fp").alias("id"), "text")), "links")
    release(docs.sparkSession)
    found = connected_components(links)
    many = member.where("blocks > 1")
    if many.limit(1).count():
        label = many.join(found, F.col("fp") == F.col("node"), "left").select(
            "g", "fp", "rep", "n", "block", "blocks", F.coalesce("component", "fp").alias("label"))
        label = materialize(label, "labels")
        top = label.groupBy("g", "label").agg(F.count("*").alias("m")).groupBy("g").agg(
            F.max(F.struct("m", "label")).alias("top")).select("g", F.col("top.label").alias("top"))
        label = label.join(top, "g").withColumn("out", F.col("label") != F.col("top"))
        # as many strips as the outside sets fill blocks
        outs = label.where("out").groupBy("g").agg(F.ceil(F.greatest(
            F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("strips"))
        label = materialize(label.join(outs, "g").withColumn("strip", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("strips"))
                                                             .cast("int")), "outside")
        cross = label.select(
            "fp", "rep", "label", F.col("g").alias("g1"),
            F.explode(F.concat(
                F.when(F.col("out"), F.expr("""transform(sequence(0, blocks - 1),
                    b -> struct(strip as g2, b as g3, 0 as side))""")).otherwise(F.expr("cast(array() as array<struct<g2:int,g3:int,side:int>>)")),
                F.expr("transform(sequence(0, strips - 1), s -> struct(s as g2, block as g3, 1 as side))"))).alias("x"))
        cross = cross.select(F.col("rep.doc_id").alias("__id"), F.col("rep.th").alias("__th"), "fp", "label", "g1", "x.*")
        both = d.join(materialize(cross, "cross").hint("merge"),
                      F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
        more = linked_two(both, k, num, den)
        found = connected_components(links.unionByName(materialize(more, "links2")))

    own = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("c"))
    own = materialize(own, "own")
    ids = own.groupBy("c").agg(F.min("first").alias("component_id"))
    named = materialize(own.join(ids, "c").select(F.col("fp").alias("__fp"), "c", "component_id"), "named")
    release(docs.sparkSession)
    out = rows.join(small_side(named), F.col("fp") == F.col("__fp"), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "fp",
                      F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "c")


def linked_two(both: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between strips of outside sets (side 0) and blocks (side 1)."""
    parts = both.select("g1", "g2", "g3", "side", "label", F.col("fp").alias("id"), "text")
    parts = parts.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "side", "id")
    return parts.mapInArrow(_verifier(k, num, den), "a long, b long")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one of each component, that with the smallest id and text hash.

    Documents without words have no near copies and stay.
    """
    c = _components(docs, k, num, den, doc_id)
    first = c.where("fp is not null").groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("keep"))
    first = first.select(F.col("keep.doc_id").alias("__id"), F.col("keep.th").alias("__th"))
    empty = c.where("fp is null").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    keep = materialize(first.unionByName(empty), "keep")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).alias("__a"), F.xxhash64(text).alias("__b"),
                    F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("__row"))
    repeats = _repeats(c)
    if repeats:
        d = d.mapInArrow(_first_rows, d.schema)
    out = d.join(small_side(keep), F.col("__a").eqNullSafe(F.col("__id")) & (F.col("__b") == F.col("__th")))
    if repeats:
        out = out.dropDuplicates(["__a", "__b"])      # a row that is repeated in full stays once
    return out.select("__row.*")
