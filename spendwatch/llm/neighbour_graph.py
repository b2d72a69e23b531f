"""Approximate nearest neighbours by cosine: NN-descent and greedy search of its graph.

Index.  Vectors that are equal up to a power of two are one node, so copies
cannot fill each other's lists.  A node carries its vector in 8 bits a
component.  The first lists come from ``TREES`` orders of the nodes by the
signs of random hyperplanes: neighbours in an order are compared in blocks.
Each round of NN-descent then sends every node's code along its edges, in both
directions; whoever receives codes compares them with each other and offers
each the pairs that beat the worst entry of its list.  Pairs of which both
edges are old were compared before and are skipped.  Rounds end when fewer than
``SETTLED`` of all edges are new.  A list holds ``DEGREE`` nodes; of the nodes
that list a node, as many are drawn by a hash each round, new edges first, so
a node that very many list is no single task's work: its offers are cut to the
best before they move.

Search.  All queries advance together: a round expands the ``WIDTH`` best
nodes not yet expanded of each query's beam of ``BEAM``, joins their lists and
the codes met, and ends for a query when its whole beam is expanded.  A query
that is a node starts there, any other at the best of ``ENTRIES`` nodes with
the smallest hashes.  The ``RERANK`` best by code are scored on the original
vectors in double precision, and nodes are replaced by their rows.

All rows are indexed and compared; the graph is approximate, and recall is
measured against brute force in the tests (README has the figures).

Defined cases: a vector that is null, empty or zero or holds a null or
non-finite component, and a row without vec_id, take no part; vectors of
different lengths compare as if the shorter ended in zeros; a row that repeats
a vec_id is a candidate and a query of its own; ties go to the smaller vec_id;
fewer candidates than asked for are all returned; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

DEGREE = 32
TREES = 3
BLOCK = 256                # nodes compared with each other in the first lists
SETTLED = 0.02
MAX_ROUNDS = 16
BEAM, WIDTH = 128, 24
ENTRIES = 64
RERANK = 32
SIGNS = 60                 # hyperplanes of one order
SEED = 20240229
_ROWS = 400                # rows of a batch handled at once in Python


@dataclass
class Index:
    nodes: DataFrame       # id, code
    vectors: DataFrame     # id, vector (scaled by a power of two), norm
    rows: DataFrame        # vec_id, id
    members: DataFrame     # vec_id, id, nth: rows of a node, the smallest ids
    edges: DataFrame       # v, u, sim, fresh


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vector: Column) -> Column:
    """``vector`` times a power of two that brings its largest component near 1: exact, and squares stay finite."""
    top = F.array_max(F.transform(vector, F.abs))
    half = F.floor(F.log2(top) / 2)
    a, b = F.pow(F.lit(2.0), -half), F.pow(F.lit(2.0), half - F.floor(F.log2(top)))
    return F.transform(vector, lambda x: x * a * b + 0.0)      # + 0.0: no negative zero


def matrix(codes: pa.Array) -> np.ndarray:
    """Unit rows of a binary column of signed bytes; shorter ones end in zeros."""
    if not len(codes):
        return np.zeros((0, 1), np.float32)
    codes = codes.cast(pa.large_binary())
    off = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset:codes.offset + len(codes) + 1]
    size = np.diff(off)
    data = np.frombuffer(codes.buffers()[2], np.int8)[off[0]:off[-1]]
    if (size == size[0]).all():
        z = data.reshape(len(codes), size[0]).astype(np.float32)
    else:
        z = np.zeros((len(codes), size.max()), np.float32)
        row = np.repeat(np.arange(len(codes)), size)
        z[row, np.arange(len(data)) - np.repeat(off[:-1] - off[0], size)] = data
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def _codes(batches):
    planes = {}
    for b in batches:
        for lo in range(0, b.num_rows, _ROWS):
            s = b.slice(lo, _ROWS)
            codes, signs = [], []
            for v in s.column("vector").to_pylist():
                x = np.asarray(v)
                codes.append(np.rint(x * (127 / np.abs(x).max())).astype(np.int8).tobytes())
                if len(x) not in planes:
                    rng = np.random.default_rng(SEED)       # a shorter vector meets the first rows of the same planes
                    planes[len(x)] = rng.standard_normal((len(x), TREES * SIGNS))
                bits = (x @ planes[len(x)] > 0).reshape(TREES, SIGNS)
                signs.append((bits @ (1 << np.arange(SIGNS, dtype=np.int64)[::-1])).tolist())
            yield pa.RecordBatch.from_arrays([s.column("id"), pa.array(codes, pa.binary()), pa.array(signs, pa.list_(pa.int64()))],
                                             names=["id", "code", "signs"])


def _edge_batch(v, u, sim, degree):
    """The best ``degree`` offers of each v, each u once."""
    order = np.lexsort((u, -sim, v))
    v, u, sim = v[order], u[order], sim[order]
    if len(v):
        key = np.lexsort((u, v))
        again = np.zeros(len(v), bool)
        again[key[1:]] = (v[key[1:]] == v[key[:-1]]) & (u[key[1:]] == u[key[:-1]])
        v, u, sim = v[~again], u[~again], sim[~again]
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        nth = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v))))
        v, u, sim = v[nth < degree], u[nth < degree], sim[nth < degree]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(sim, pa.float32())],
                                      names=["v", "u", "sim"])


def _first_lists(degree):
    def of(ids, codes):
        z = matrix(codes)
        sim = z @ z.T
        sim[ids[:, None] == ids[None, :]] = -9
        k = min(degree, len(ids))
        best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        v, u, s = np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel()
        return _edge_batch(v[s > -9], u[s > -9], s[s > -9], degree)

    def run(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while held.num_rows >= 2 * BLOCK:       # the last block of a task has up to twice the rows, none has few
                part, held = held.slice(0, BLOCK).combine_chunks(), held.slice(BLOCK)
                yield of(part["id"].to_numpy(), part["code"].combine_chunks())
        if held is not None and held.num_rows:
            held = held.combine_chunks()
            yield of(held["id"].to_numpy(), held["code"].combine_chunks())
    return run


def _compare(degree):
    """Local joins: the codes that one node received are compared with each other."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                m = b.slice(lo, _ROWS).column("m")
                off = m.offsets.to_numpy() - m.offsets[0].as_py()
                flat = m.flatten()
                ids, worst, fresh = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("u", "worst", "fresh"))
                z, out = matrix(flat.field("code")), []
                for s, e in zip(off[:-1], off[1:]):
                    own, at = np.unique(ids[s:e], return_index=True)     # a fresh edge is sent first
                    at += s
                    sim = z[at] @ z[at].T
                    f = fresh[at]
                    ok = (f[:, None] | f[None, :]) & (sim > worst[at][:, None])
                    np.fill_diagonal(ok, False)
                    i, j = np.nonzero(ok)
                    out.append((own[i], own[j], sim[i, j]))
                yield _edge_batch(*[np.concatenate(x) for x in zip(*out)], degree)
    return run


_EDGE = "v long, u long, sim float"


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """Each node's best ``degree`` distinct edges; an edge is fresh if every offer of it is."""
    once = edges.repartition("v").groupBy("v", "u").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.col("sim").desc(), "u"))
    return once.withColumn("nth", nth).where(F.col("nth") <= degree).drop("nth")


def _messages(nodes: DataFrame, edges: DataFrame, degree: int, turn: int) -> DataFrame:
    """(v, m): what each node receives: the nodes it lists, and a draw of those that list it."""
    worst = edges.groupBy(F.col("v").alias("id")).agg(F.min("sim").alias("s"), F.count("*").alias("n"))
    sender = nodes.join(worst, "id", "left").select(
        F.col("id").alias("u"), "code", F.when(F.col("n") >= degree, F.col("s")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    sent = edges.select(F.explode(F.array(
        F.struct("v", "u", F.lit(0).alias("kind"), "fresh"),
        F.struct(F.col("u").alias("v"), F.col("v").alias("u"), F.lit(1).alias("kind"), F.col("fresh")))).alias("x")).select("x.*")
    mail = sent.join(sender, "u").repartition("v")
    draw = Window.partitionBy("v", "kind").orderBy(F.col("fresh").desc(), F.xxhash64(F.lit(turn), "u"))
    mail = mail.withColumn("nth", F.row_number().over(draw)).where((F.col("kind") == 0) | (F.col("nth") <= degree))
    got = F.sort_array(F.collect_list(F.struct((~F.col("fresh")).alias("old"), "u", "code", "worst", "fresh")))
    return mail.groupBy("v").agg(got.alias("m")).where(F.exists("m", lambda x: x["fresh"]))


def build(vectors: DataFrame, keep: int = 6, degree: int = DEGREE) -> Index:
    """Index of (vec_id, vector) rows; ``keep`` rows of a node are kept for answers, the smallest ids."""
    spark = vectors.sparkSession
    raw = F.col("vector").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), raw.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select("vec_id", scaled(F.col("vector")).alias("vector"))
    rows = rows.select("*", *[F.xxhash64(F.lit(i), "vector").alias(f"h{i}") for i in (1, 2)])
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    own = rows.groupBy("h1", "h2").agg(F.first("vector").alias("vector")).sortWithinPartitions("h1", "h2")
    own = materialize(own.select("h1", "h2", F.monotonically_increasing_id().alias("id"), "vector", norm.alias("norm")), "ann_vectors")
    named = materialize(rows.select("vec_id", "h1", "h2").join(own.select("h1", "h2", "id"), ["h1", "h2"]).select("vec_id", "id"), "ann_rows")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    members = named.withColumn("nth", nth).where(F.col("nth") <= keep)
    coded = materialize(own.select("id", "vector").mapInArrow(_codes, "id long, code binary, signs array<long>"), "ann_codes")
    nodes = coded.select("id", "code")
    dealt = coded.select("id", "code", F.posexplode("signs").alias("tree", "sign")).repartitionByRange("tree", "sign", "id")
    first = dealt.sortWithinPartitions("tree", "sign", "id").select("id", "code").mapInArrow(_first_lists(degree), _EDGE)
    edges = materialize(_best(first.withColumn("fresh", F.lit(True)), degree), "ann_edges")
    for turn in range(MAX_ROUNDS):
        found = _messages(nodes, edges, degree, turn).select("m").mapInArrow(_compare(degree), _EDGE)
        both = edges.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
        edges = materialize(_best(both, degree), "ann_edges")
        total, new = edges.agg(F.count("*"), F.count_if("fresh")).first()
        release(spark)
        if new <= SETTLED * total:
            break
    return Index(nodes, own.select("id", "vector", "norm"), named, members, edges)


def _advance(beam, width):
    """One round of the search: the codes met enter the beam, the best not yet expanded are next."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                s = b.slice(lo, _ROWS)
                cols = {c: s.column(c).to_pylist() for c in ("q", "code", "c", "sim", "done")}
                met, out = s.column("met"), []
                for i, (q, code, c, sim, done) in enumerate(zip(*cols.values())):
                    c, sim, done = np.array(c, np.int64), np.array(sim, np.float32), np.array(done, bool)
                    got = met[i].values
                    if got is not None and len(got):
                        u = got.field("u").to_numpy()
                        new = ~np.isin(u, c)
                        z = matrix(pa.concat_arrays([got.field("code").cast(pa.binary()), pa.array([code], pa.binary())]))
                        c = np.concatenate([c, u[new]])
                        sim = np.concatenate([sim, (z[:-1] @ z[-1])[new]])
                        done = np.concatenate([done, np.zeros(new.sum(), bool)])
                    best = np.lexsort((c, -sim))[:beam]
                    c, sim, done = c[best], sim[best], done[best]
                    nxt = np.flatnonzero(~done)[:width]
                    done[nxt] = True
                    out.append((q, code, c.tolist(), sim.tolist(), done.tolist(), c[nxt].tolist()))
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                                                 names=["q", "code", "c", "sim", "done", "front"])
    return run


_STATE = "q long, code binary, c array<long>, sim array<float>, done array<boolean>, front array<long>"


def search(index: Index, queries: DataFrame, beam: int = BEAM, width: int = WIDTH, known: bool = True) -> DataFrame:
    """(q, id, sim): the beam of every query of (q, code); ``known``: q is a node, where its search starts."""
    none = "cast(array() as array<{}>)".format
    if known:
        start = queries.withColumn("met", F.array(F.struct(F.col("q").alias("u"), "code")))
    else:
        entries = index.nodes.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(ENTRIES)
        entries = entries.agg(F.collect_list(F.struct(F.col("id").alias("u"), "code")).alias("met"), F.lit(1).alias("one"))
        start = queries.withColumn("one", F.lit(1)).join(F.broadcast(entries), "one")       # one row of ENTRIES codes
    start = start.select("q", "code", *[F.expr(none(t)).alias(c) for c, t in (("c", "bigint"), ("sim", "float"), ("done", "boolean"))], "met")
    lists = materialize(index.edges.groupBy("v").agg(F.collect_list("u").alias("near")), "ann_lists")
    state = materialize(start.mapInArrow(_advance(beam, width), _STATE), "ann_search")
    while True:
        active = state.where(F.size("front") > 0)
        if not active.limit(1).count():
            break
        faced = active.select("q", F.explode("front").alias("v")).join(lists, "v").select("q", F.explode("near").alias("u")).distinct()
        coded = faced.join(index.nodes.select(F.col("id").alias("u"), "code"), "u")
        got = coded.groupBy("q").agg(F.collect_list(F.struct("u", "code")).alias("met"))
        moved = active.drop("front").join(got, "q", "left").mapInArrow(_advance(beam, width), _STATE)
        state = materialize(moved.unionByName(state.where(F.size("front") == 0)), "ann_search")
    release(queries.sparkSession)
    return state.select("q", F.explode(F.arrays_zip("c", "sim")).alias("x")).select("q", F.col("x.c").alias("id"), F.col("x.sim").alias("sim"))


def cosine(a: str, b: str) -> Column:
    """Cosine of two vector columns with norms in ``a_norm`` and ``b_norm``."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0),
                      lambda s, x: s + x)
    return dot / (F.col(f"{a}_norm") * F.col(f"{b}_norm"))


def scored(index: Index, beams: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, id, score) of the best of each beam; ``asked`` has q, qv and qv_norm."""
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "id"))
    best = beams.withColumn("nth", nth).where(F.col("nth") <= RERANK).select("q", "id")
    found = index.vectors.select("id", F.col("vector").alias("cv"), F.col("norm").alias("cv_norm"))
    return best.join(found, "id").join(asked, "q").select("q", "id", cosine("qv", "cv").alias("score"))


def answers(index: Index, scores: DataFrame, k: int) -> DataFrame:
    """(q, near): the ``k`` best rows of each q in order, rows of a node by vec_id."""
    level = F.rank().over(Window.partitionBy("q").orderBy(F.col("score").desc()))
    rows = scores.withColumn("level", level).where(F.col("level") <= k).join(index.members, "id")
    each = F.struct((-F.col("score")).alias("minus"), "vec_id", "id", "nth", "score")
    return rows.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(each)), 1, k).alias("near"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of every row of (vec_id, vector) that ``is_query``,
    a condition on vec_id."""
    index = build(vectors, keep=k + 1)
    asked = index.rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    places = materialize(asked.select("q").distinct(), "ann_queries")
    beams = search(index, places.join(index.nodes.select(F.col("id").alias("q"), "code"), "q"))
    own = index.vectors.select(F.col("id").alias("q"), F.col("vector").alias("qv"), F.col("norm").alias("qv_norm"))
    near = answers(index, scored(index, beams, places.join(own, "q")), k + 1)
    # a row is no candidate of its own: of the rows with its id at its node, one goes
    out = asked.join(near, "q").withColumn("self", F.expr(
        "array_min(transform(filter(near, x -> x.id = q and x.vec_id = query_id), x -> x.nth))"))
    out = out.withColumn("near", F.expr(f"slice(filter(near, x -> not (x.id = q and x.nth <=> self)), 1, {k})"))
    return out.select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def search_vectors(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (query_id, vector) from outside the index; query_id is unique."""
    raw = F.col("vector").cast("array<double>")
    rows = queries.select(F.col("query_id").alias("q"), raw.alias("vector"))
    rows = rows.where(F.col("q").isNotNull() & usable(F.col("vector"))).select("q", scaled(F.col("vector")).alias("qv"))
    rows = materialize(rows.withColumn("qv_norm", F.sqrt(F.aggregate("qv", F.lit(0.0), lambda a, x: a + x * x))), "ann_queries")
    coded = rows.select(F.col("q").alias("id"), F.col("qv").alias("vector")).mapInArrow(_codes, "id long, code binary, signs array<long>")
    beams = search(index, coded.select(F.col("id").alias("q"), "code"), known=False)
    near = answers(index, scored(index, beams, rows), k)
    return near.select(F.col("q").alias("query_id"), F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
