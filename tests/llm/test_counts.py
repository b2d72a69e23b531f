"""Sharding, token counts, quality rules and source mix against plain loops."""

import collections
import json
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spendwatch.llm import bin_packing, host_rules, source_mix, token_counts
from spendwatch.llm.oracle import ORACLE
from spendwatch.llm.queries import REGISTRY

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "one", "one two", "a b c a b c a b c", "x" * 300_000, "the cat sat\nthe cat sat\n\n \nthe cat sat ",
       "é€ ünï 日本 <|endoftext|> it's 12,5 <b>&", "dup dup dup dup dup dup", "A B a\u0085b"] + ["same text here"] * 6


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, ("s%d" % (i % 3)) if i % 5 else None, "clash", 1.0) for i, t in enumerate(ODD)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, size double").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_measures(which, request):
    df = request.getfixturevalue(which)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                               r.base_failed) for r in host_rules.quality_rules(df).collect())
    want = collections.Counter()
    for r in df.collect():
        m = measures(r.text)
        want[(r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want


def test_long_repeat_form(spark, monkeypatch):
    """The form for texts beyond the key's position bits gives the same counts."""
    df = spark.createDataFrame([(1, "a b c d a b c e f a b c x y x y x y", "s")], "doc_id long, text string, source string")
    want = measures(df.first().text)[4]
    monkeypatch.setattr(host_rules, "_POS", 4)
    assert host_rules.quality_rules(df).first().n_repeat_words == want


def test_bad_host_loses_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad" if i < 100 else good, "h1") for i in range(110)] + [(200 + i, good, f"g{i % 9}") for i in range(300)]
    df = spark.createDataFrame(rows + [(900, good, None)], "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in host_rules.quality_rules(df).collect()}
    assert not any(got[i] for i in range(110)) and all(v for k, v in got.items() if k >= 200)
    assert {r.doc_id for r in host_rules.keep_documents(df).collect()} == {k for k, v in got.items() if v}


def targets(rows):
    size = collections.Counter()
    for src, n in rows:
        size[src] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        t = {s: 3.0 * size[s] if s in capped else weight[s] * rest / w for s in order}
        over = {s for s in order if s not in capped and t[s] > 3 * size[s]}
        if not over:
            return size, t
        capped |= over


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix(which, request):
    df = request.getfixturevalue(which)
    rows = df.collect()
    size, target = targets([(r.source, len(WORD.findall(r.text or ""))) for r in rows])
    got = source_mix.mix(df, block_words=300).collect()
    assert len(got) == len(rows)
    taken, largest, shards = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.times * r.size and 0 <= r.times <= 3
        assert (r.shards is None) == (r.times == 0) and len(r.shards or []) == r.times
        assert all(s is not None for s in r.shards or [])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        shards.update(r.shards or [])
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]
    if which == "docs":
        assert sorted(shards) == list(range(8))
    assert sorted(got, key=str) == sorted(source_mix.mix(df.repartition(5), block_words=300).collect(), key=str)
    out = source_mix.mix_documents(df)
    assert out.columns == df.columns


def test_rows_without_id_are_decided_singly(spark):
    """Half of the ids null, a third of the others the same: taken words stay within one document of the target."""
    rows = [(None if i % 2 else (7 if i % 3 == 0 else i), " ".join(f"w{i}" for _ in range(100)), "abc"[i * i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken, target = collections.Counter(), {}
    for r in source_mix.mix(df, block_words=2_000).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 100 for s, t in target.items())
    mixed = collections.Counter(r.source for r in source_mix.mix_documents(df).collect())
    assert all(abs(100 * mixed[s] - t) <= 100 + 2_000 for s, t in target.items())


def test_full_repeats_are_decided_singly(spark):
    """Half of a source repeats one id and text, or has no id: each row is drawn by itself and keeps its own columns."""
    rows = [(None if i % 2 else 5, " ".join(["w"] * 50), "a" if i < 900 else "b", i) for i in range(1200)]
    rows += [(10_000 + i, f"x{i} y z", "c", 5_000 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(6)
    got = source_mix.mix(df, block_words=1_000).collect()
    assert len(got) == len(rows)
    taken, target, copies = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        copies[r.source] += r.times
    assert all(abs(taken[s] - t) <= 50 for s, t in target.items())
    plain = [(r.doc_id, r.source, r.r, r.times) for r in got]
    again = source_mix.mix(df.repartition(3), block_words=1_000).collect()
    assert sorted(plain, key=str) == sorted([(r.doc_id, r.source, r.r, r.times) for r in again], key=str)
    placed = source_mix.place(df, block_words=1_000).select("__row.*", "shard", "position").collect()
    assert collections.Counter(r.source for r in placed) == copies
    assert max(collections.Counter(r.n for r in placed).values()) <= 3
    assert len({r.position for r in placed}) == len(placed)
    want = collections.Counter(r.times for r in got if r.times)
    assert collections.Counter(collections.Counter(r.n for r in placed).values()) == want


def test_mixed_rows_come_by_shard_in_hash_order(docs):
    at = [r.shards for r in source_mix.mix(docs).collect() if r.shards]
    placed = source_mix.place(docs).select("__row.doc_id", "shard", "position").collect()
    assert collections.Counter(s for x in at for s in x) == collections.Counter(r.shard for r in placed)
    assert len({r.position for r in placed}) == len(placed)
    want = [r.doc_id for r in sorted(placed, key=lambda r: (r.shard, r.position))]
    assert want != sorted(want)
    for df in (docs, docs.repartition(5)):
        assert [r.doc_id for r in source_mix.mix_documents(df).collect()] == want


def test_taken_follows_the_tree(docs, monkeypatch):
    whole = source_mix.split_quotas
    monkeypatch.setattr(source_mix, "split_quotas", lambda q, n: whole(q, n).where("shard <> 3"))
    got = source_mix.mix(docs).collect()
    assert all(3 not in (r.shards or []) and len(r.shards or []) == r.times for r in got)
    assert all(r.taken == r.times * r.size for r in got)
    full = {r.doc_id: r.taken for r in got}
    monkeypatch.setattr(source_mix, "split_quotas", whole)
    assert sum(full.values()) < sum(r.taken for r in source_mix.mix(docs).collect())


def test_quota_tree_uses_every_block(spark):
    q = [1000.0, 0.0, 3.0, 77.0, 50_000.0]
    got = source_mix.split_quotas(spark.createDataFrame([(q,)], "q array<double>"), 8).collect()
    per, shard = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.lo < r.hi <= q[r.source_no]
        per[r.source_no] += r.hi - r.lo
        shard[r.shard] += r.hi - r.lo
    assert [per[i] for i in range(5)] == q
    assert max(shard.values()) - min(shard.values()) <= 2
    # the draw is spread as the law says: source 4 holds 98 % of every shard
    assert all(abs(r.hi - r.lo - 6250) < 150 for r in got if r.source_no == 4)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    rows = df.collect()
    got = bin_packing.shard_documents(df).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, at = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        assert 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        at[(r.size, r.text_crc32)].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for k, v in at.items() if k[0] > 1)      # null and empty texts are two groups
    if which == "docs":
        total = collections.Counter()
        for r in got:
            total[r.shard] += r.size
        assert max(total.values()) - min(total.values()) < 0.05 * max(total.values())


def test_best_fit_decreasing_loop():
    sizes = sorted([7, 3, 9, 4, 4, 6, 1, 1, 8, 2, 5], reverse=True)
    free, want = [], []
    for s in sizes:
        fits = [i for i, f in enumerate(free) if f >= s]
        if not fits:
            free.append(12)
            fits = [len(free) - 1]
        b = min(fits, key=lambda i: (free[i], i))
        free[b] -= s
        want.append(b)
    assert bin_packing.best_fit_decreasing(sizes, 12) == want
    assert max(bin_packing.pack([100] + [1] * 70, 8)) == 7


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_counts(which, request):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_counts.default_tokenizer())
    df = request.getfixturevalue(which)
    got = token_counts.token_counts(df, budget=100, prefixes=True).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids))
                               for r in df.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in got[:25]:
        t = texts[r.doc_id]
        n = lambda i: len(tok.encode(t[:i], add_special_tokens=False).ids)
        assert n(r.budget_chars) <= 100
        for e, c in list(zip(r.prefix_ends, r.prefix_tokens))[:40]:
            assert n(e) == c


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers(spark, file):
    """Counts and prefix tables are the library's whatever the file: cuts are read from it."""
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(file)
    tok = Tokenizer.from_file(path)
    texts = ["", None, "Two words, THREE  Words.", "a\u00a0 b \u00a0c \u00a0 d", " lead and trail ", "x <|endoftext|> y<|endoftext|>z",
             "tab\tnew\n line\n\n  it's WE'LL 12 345", "\u65e5\u672c \u8a9e \u00e9 e\u0301 a", "A" * 3000 + " B", "\x1c q \x1f r"]
    rnd = random.Random(8)
    texts += ["".join(rnd.choices("aB1,' \n\u00e9\u00a0\u65e5", k=60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for r in token_counts.token_counts(docs, path=path, budget=10, prefixes=True).collect():
        t = texts[r.doc_id] or ""
        assert r.n_tokens == n(t)
        assert list(r.prefix_tokens) == [n(t[:e]) for e in r.prefix_ends]
        assert r.budget_chars == max([e for e, c in zip(r.prefix_ends, r.prefix_tokens) if c <= 10] + [0]) or r.n_tokens <= 10
    assert token_counts.safe_cuts(json.loads(tok.to_str())) == (("spaces", False) if file.startswith("byte") else ("gaps", True))
    assert token_counts.safe_cuts({"normalizer": {"type": "Prepend"}, "pre_tokenizer": None}) == ("none", False)


def test_prefix_inside_a_piece():
    c = token_counts.PieceCounter(token_counts.default_tokenizer())
    t = "The étrange-looking wordlets, it's 2024 <|endoftext|>x"
    table = c.prefix_table(t)
    for i in range(len(t) + 1):
        assert c.at(t, table, i) == len(c.tok.encode(t[:i], add_special_tokens=False).ids)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (bin_packing.shard_documents, host_rules.quality_rules, host_rules.keep_documents, source_mix.mix,
              source_mix.mix_documents, token_counts.token_counts):
        assert f(none).count() == 0
