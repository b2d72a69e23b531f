"""N-gram join and benchmark search against plain loops."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendwatch.llm import decontaminate, ngram_join
from spendwatch.llm.queries import REGISTRY
from spendwatch.llm.words import ALNUM, SPACED, Words, chunks, shingle_sets

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, " \n\t ", "one", "ONE", "one two", "One  two", "a b c", "A\tb c", "x" * 300_000, "é É ç " * 40, "é É ç",
       " ".join(f"w{i}" for i in range(60_000)), " ".join(f"w{i}" for i in range(60_500)), "\x00 nul \x00", "p q r s t"]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def grams(text, k):
    w = WORD.findall(low(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, num, den):
    """Plain loop over all pairs that share a shingle."""
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    shared = collections.Counter((i, j) for v in by.values() for a, i in enumerate(v) for j in v[:a])
    for (i, j), n in shared.items():
        if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def near_copies(n, size, edits, seed):
    """A chain of copies, each a few edits from an earlier one."""
    rnd = random.Random(seed)
    out = [[f"v{rnd.randrange(4000)}" for _ in range(size)]]
    for _ in range(n - 1):
        t = list(rnd.choice(out[-20:]))
        for _ in range(rnd.randrange(edits + 1)):
            t[rnd.randrange(len(t))] = f"v{rnd.randrange(4000)}"
        out.append(t)
    return [" ".join(t) for t in out]


def frame(spark, texts, first=0):
    rows = [(first + i, t, "clash", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, n_shingles int").repartition(4)


def got(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_hashes_tell_words_apart():
    import pyarrow as pa
    words = sorted({"".join(random.Random(i).choices("abé", k=i % 9 + 1)) for i in range(4000)})
    seen = {}
    for first, _, data, bounds in chunks(pa.array([" ".join(words), "", None, "  a\tb\n"]), 5000):
        w = Words(data, bounds, SPACED)
        raw = w.low.tobytes()
        for h, s, e in zip(w.hash.tolist(), w.start, w.end):
            assert seen.setdefault(h, raw[s:e]) == raw[s:e]
    assert len(seen) == len(words) + ("b" not in words)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_links_on_the_documents(spark, k, num, den):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = components([(r.doc_id, r.text) for r in df.collect()], k, num, den)
    assert got(ngram_join.jaccard_components(df, k, num, den)) == want


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_links_of_near_copies(spark, k, num, den):
    texts = [t for s, size in enumerate((8, 12, 14, 20, 33, 60, 150, 400)) for t in near_copies(40, size, max(1, size // 25), s)]
    df = frame(spark, texts)
    assert got(ngram_join.jaccard_components(df, k, num, den)) == components(list(enumerate(texts)), k, num, den)


def test_blocks_of_a_large_group(spark, monkeypatch):
    """One candidate group in many blocks and strips: same components as the plain loop."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 12)
    texts = near_copies(150, 80, 4, 7) + near_copies(60, 200, 9, 8)
    want = components(list(enumerate(texts)), 3, 90, 100)
    assert len({c for _, _, c in want}) > 5
    assert got(ngram_join.jaccard_components(frame(spark, texts))) == want


def test_keys_in_passes(spark, monkeypatch):
    """The passes divide the keys evenly, and the links are those of the plain loop."""
    texts = near_copies(40, 60, 4, 5)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [sum(b.num_rows for b in ngram_join._key_rows(3, 80, 100, None, at, 4)([batch])) for at in range(4)]
    assert max(parts) < 0.35 * sum(parts)
    monkeypatch.setattr(ngram_join, "PASS_SHINGLES", 1)
    monkeypatch.setattr(ngram_join, "TASK_SHINGLES", 50)
    stages, write = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name="stage": stages.append(name) or write(df, name))
    assert got(ngram_join.jaccard_components(frame(spark, texts), 3, 80, 100)) == components(list(enumerate(texts)), 3, 80, 100)
    assert stages.count("met") == 4


def test_texts_that_share_a_passage(spark):
    """A passage in every text ties none of them, and near copies among them still link."""
    rnd = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{a} {passage} {b}" for a, b in zip(near_copies(40, 60, 2, 21), near_copies(40, 60, 2, 22))]
    texts += [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(200)) + " " + passage for _ in range(150)]
    for k, num, den in ((3, 90, 100), (5, 80, 100)):
        assert got(ngram_join.jaccard_components(frame(spark, texts), k, num, den)) == components(list(enumerate(texts)), k, num, den)


def test_odd_rows(spark):
    texts = ODD + ["p q r s t", "p q r s t"]
    rows = [(None if i == 4 else i, t, "c") for i, t in enumerate(texts)] + [(15, "p q r s t", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    want = components([r[:2] for r in rows], 3, 90, 100)
    assert got(ngram_join.jaccard_components(df)) == want
    kept = ngram_join.keep_one(df, 3, 90, 100)
    assert kept.columns == df.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[15] == 1 and ids[16] == 0 and ids[0] == ids[1] == ids[2] == 1 and ids[6] == 0 and ids[5] == 1


def test_null_and_repeated_ids_keep_unrelated_texts(spark):
    rnd = random.Random(9)
    texts = [" ".join(f"u{rnd.randrange(10 ** 6)}" for _ in range(40)) for _ in range(12)]
    rows = [(None, t, i) for i, t in enumerate(texts[:8])] + [(1, texts[8], 8), (1, texts[9], 9), (2, texts[9] + " end", 10)]
    rows += [(3, texts[10], 11), (None, texts[11], 12), (4, texts[11], 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = ngram_join.keep_one(df).collect()
    assert len(kept) == 12 and {r.n for r in kept} >= {*range(10), 11}
    assert ngram_join.jaccard_components(df).columns == ["doc_id", "th", "n_shingles", "fp", "component_id"]


def test_repeated_rows_reach_a_verifier_once(spark):
    """3,000 equal rows without id and two near copies are three texts, and one row stays."""
    words = [f"v{i}" for i in range(200)]
    same, near, far = " ".join(words), " ".join(words + ["x"]), " ".join(words[1:] + ["y", "z"])
    rows = [(None, same, i) for i in range(3000)] + [(1, near, 3000), (2, far, 3001), (3, "one other text here " * 3, 3002)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(6)
    assert sum(r.doc_id is None for r in df.select("doc_id", F.xxhash64("text"), "text").mapInArrow(
        ngram_join._first_rows, "doc_id long, th long, text string").collect()) == 6
    got = ngram_join.jaccard_components(df, 5, 80, 100).collect()
    assert len(got) == 3003 and {r.component_id for r in got} == {1, 3}
    kept = ngram_join.keep_one(df).collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} <= {None, 1, 2, 3}


def test_a_verifier_holds_equal_rows_once():
    words = [f"v{i}" for i in range(50)]
    texts = {1: " ".join(words), 2: " ".join(words + ["x"])}
    rows = [(7, 0, 0, 0, i, i, texts[i]) for i in (1, 2) for _ in range(400)]
    cols = [pa.array(c, pa.string() if n == 6 else pa.int64()) for n, c in enumerate(zip(*rows))]
    batch = pa.RecordBatch.from_arrays(cols, names=list("abcdefg"))
    seen = []
    plain = ngram_join.verify
    try:
        ngram_join.verify = lambda sets, *rest: seen.append(len(sets)) or plain(sets, *rest)
        links = [x for b in ngram_join._verifier(5, 80, 100)([batch]) for x in b.to_pylist()]
    finally:
        ngram_join.verify = plain
    assert seen == [2] and links == [{"a": 1, "b": 2}]


def test_no_key_is_lost_in_sparse_sketches():
    """Every linked pair shares a key, for sizes around the band limits."""
    rnd = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100)):
        bands = ngram_join.Bands(num, den)
        for n in [*range(1, 60), 97, 200, 999]:
            for _ in range(25):
                a = rnd.integers(1, 1 << 63, n, dtype=np.uint64)
                b = a.copy()
                for _ in range(n):
                    c = b.copy()
                    c[rnd.integers(len(c))] = rnd.integers(1, 1 << 63, dtype=np.uint64)
                    c = c[1:] if rnd.random() < 0.2 else c
                    both = len(np.intersect1d(a, c))
                    if den * both < num * (len(a) + len(c) - both) or not len(c):
                        break
                    b = c
                sets = [np.unique(a), np.unique(b)]
                at = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
                ids = np.array([1, 2], np.uint64)
                if set(sets[0].tolist()) == set(sets[1].tolist()):
                    continue
                # whatever is held to be common: nothing, some of one set, or all of both
                some = np.sort(rnd.choice(sets[0], max(1, n // 3), replace=False))
                for common in (None, some, np.unique(np.concatenate(sets))):
                    key, own = ngram_join.join_keys(np.concatenate(sets), at, ids, bands, common)
                    assert set(key[own == 1].tolist()) & set(key[own == 2].tolist()), (num, n)


def test_linked_sets_share_what_they_promise():
    """In some seed a linked pair shares as many keys as either set promises, whatever is held to be common."""
    rnd = np.random.default_rng(6)
    for num, den in ((90, 100), (80, 100)):
        bands = ngram_join.Bands(num, den)
        for n in [*range(2, 40), 97, 240, 999, 4200]:
            for _ in range(10):
                a = rnd.integers(1, 1 << 63, n, dtype=np.uint64)
                b = a.copy()
                for j in rnd.permutation(n)[:n * (den - num) // (den + num)]:
                    b[j] = rnd.integers(1, 1 << 63, dtype=np.uint64)
                b = b[rnd.integers(2):]
                both = len(np.intersect1d(a, b))
                if not both or len(a) + len(b) == 2 * both or den * both < num * (len(a) + len(b) - both):
                    continue
                sets = [np.unique(a), np.unique(b)]
                at = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
                every = np.unique(np.concatenate(sets))
                for common in (None, rnd.choice(every, max(1, n // 8), replace=False), rnd.choice(every, max(1, n // 2)), every):
                    common = None if common is None else np.sort(common)
                    key, own, tag = ngram_join.level_keys(np.concatenate(sets), at, np.array([1, 2], np.uint64), bands, common)
                    held = [dict(zip(key[own == i].tolist(), tag[own == i].tolist())) for i in (1, 2)]
                    shared = collections.Counter((held[0][x], held[1][x]) for x in held[0].keys() & held[1].keys())
                    assert any(s >= max(x % 1024 if x & 1024 <= y & 1024 else 0, y % 1024 if y & 1024 <= x & 1024 else 0)
                               for (x, y), s in shared.items()), (num, n)


def test_long_texts_of_a_band_do_not_meet():
    """Unrelated long sets share no key, also those that join the band above their own."""
    rnd = np.random.default_rng(8)
    sizes = rnd.integers(2000, 9500, 60)
    key, own = ngram_join.join_keys(rnd.integers(1, 1 << 63, sizes.sum(), dtype=np.uint64), np.append(0, np.cumsum(sizes)),
                                    np.arange(1, 61).astype(np.uint64), ngram_join.Bands(80, 100))
    assert max(collections.Counter(key.tolist()).values()) == 1
    assert np.bincount(own.astype(int))[1:].max() < 2 * sizes.max()


def test_pairs_of_keys():
    """Pairs of the classes of each key, over batches cut anywhere; a key of too many classes gives its rows."""
    rnd = random.Random(4)
    rows = sorted({(rnd.randrange(40) ** 2 % 37, rnd.randrange(30)) for _ in range(260)} | {(50, i) for i in range(90)})
    tags = {i: i * 7 for _, i in rows}
    by = collections.defaultdict(list)
    for key, i in rows:
        by[key].append(i)
    want = collections.Counter((a, b, tags[a], tags[b]) for v in by.values() if len(v) <= 4 for j, b in enumerate(v) for a in v[:j])
    want.update((i, key, tags[i], -1) for key, v in by.items() if len(v) > 4 for i in v)
    again = sorted(rows + rows[::3])                # equal sets of several tasks
    for step in (1, 3, 7, 64, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
                                               pa.array([tags[r[1]] for r in part], pa.int32())], names=["key", "id", "tag"])
                   for part in (again[at:at + step] for at in range(0, len(again), step))]
        got = collections.Counter(tuple(r.values()) for b in ngram_join._pair_rows(4)(iter(batches)) for r in b.to_pylist())
        assert got == want, step
    assert sum(b.num_rows for b in ngram_join._pair_rows(4)(iter([]))) == 0


@pytest.mark.parametrize("paired,sample", [(2, 20_000), (3, 1), (8, 40)])
def test_keys_of_many_classes(spark, monkeypatch, paired, sample):
    """Keys beyond the pairs that are counted lose no link."""
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "SAMPLE", sample)
    texts = [t for s, size in enumerate((8, 14, 33, 60, 150, 400)) for t in near_copies(30, size, max(1, size // 20), s)]
    for k, num, den in ((3, 90, 100), (5, 80, 100)):
        assert got(ngram_join.jaccard_components(frame(spark, texts), k, num, den)) == components(list(enumerate(texts)), k, num, den)


def test_passages_that_the_sample_misses(spark, monkeypatch):
    """Texts that share passages in chains, none seen to be common, are no candidates; the near copies among them are."""
    monkeypatch.setattr(ngram_join, "SAMPLE", 0)
    rnd = random.Random(12)
    passages = [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(50)) for _ in range(40)]
    texts = []
    for _ in range(200):
        parts = [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(50)) for _ in range(4)] + rnd.sample(passages, 3)
        rnd.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [t + " one more end" for t in texts[:10]]
    rows, write = {}, ngram_join.materialize

    def spy(df, name="stage"):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", spy)
    want = components(list(enumerate(texts)), 5, 80, 100)
    assert got(ngram_join.jaccard_components(frame(spark, texts), 5, 80, 100)) == want
    assert 20 <= rows["members"] <= 40


def contamination(rows, items):
    out = collections.Counter()
    windows = {}
    for i, t in items:
        w = TOKEN.findall(low(t))
        for p in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[p:p + 10]), set()).add(i)
    lengths = {len(w) for w in windows}
    for d, t in rows:
        w = TOKEN.findall(low(t))
        hit, ids = set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    ids |= windows[tuple(w[p:p + n])]
        ids = sorted(str(i) for i in ids if i is not None)
        out[(d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))] += 1
    return out


def digest(df):
    return collections.Counter((r.c0, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(),
                                r.n_hit > 0) for r in df.collect())


def test_query_on_the_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    rows = REGISTRY["op6_decontamination"](spark, SF).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want
    assert sum(k[-1] for k in want) >= 3


@pytest.mark.parametrize("item_words", [300_000, 40])
def test_odd_items_and_item_blocks(spark, item_words):
    rnd = random.Random(4)
    words = ["a", "b", "C", "é", "7"]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 5, 9, 10, 11, 14])))) for i in range(25)]
    items = [x for x in items if x[1] not in words] + [(99, ""), (98, None), (None, "a b c é é é 7 7 7 a a"), (97, "q, W!"), (97, "q w")]
    rows = [(i, "-".join(rnd.choices(words, k=rnd.randrange(60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x q w q w"), (102, "x q w q w"), (None, "Q.W"), (103, "é" * 200_000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert digest(decontaminate.decontaminate(docs, bench, item_words=item_words)) == contamination(rows, items)


def test_many_blocks_and_long_items(spark):
    """Few and many blocks: items longer than a block keep every window, equal texts are found once, the plan stays flat."""
    rnd = random.Random(6)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(words, k=n))) for i, n in enumerate([700, 260, 95, 41, 10, 9, 1] + [12] * 30)]
    items += [(items[0][0], items[0][1]), (500, items[0][1])]
    cut = [items[0][1].split(" ")[a:a + 10] for a in range(0, 690, 23)]
    rows = [(i, " ".join(rnd.choices(words, k=20) + c + rnd.choices(words, k=5))) for i, c in enumerate(cut)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(items)] + [(900, rows[0][1]), (900, rows[0][1]), (901, None), (902, "")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(rows, items)
    depth = {}
    for item_words in (100, 900):
        blocks = decontaminate.pattern_tables(bench, item_words=item_words)[1]
        out = decontaminate.decontaminate(docs, bench, item_words=item_words)
        assert digest(out) == want
        depth[blocks] = out._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert max(depth) >= 20 and 1 < min(depth) < 5 and len(set(depth.values())) == 1


def test_empty_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert ngram_join.jaccard_components(docs.where("false")).count() == 0
    assert ngram_join.keep_one(docs.where("false")).count() == 0
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0
