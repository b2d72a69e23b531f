"""The conversation trie against a plain dictionary of prefixes, its parts against loops."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from spendwatch.llm import prefix_trie
from spendwatch.llm.oracle import ORACLE

from ..conftest import SF


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))).encode()).hexdigest())
                  for k, m in members.items())


def got(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=lambda r: r[:2])


SCHEMA = "conv_id long, turn long, role string, text string, g long, d string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(parts)


def odd():
    rnd = random.Random(5)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rnd.choice("xyz") * (1 + t)) for c in range(-103, 330, 3) for t in range(rnd.randint(1, 9))]
    rows += [(100, t, "user", "xx") for t in range(3)] + [(400, None, "user", "first"), (400, 0, None, None), (400, 0, "", ""), (401, 5, "user", "")]
    rows += [(None, 0, "user", "no conversation"), (500, 1, "é" * 40, "b" * 200), (500, 1, "é" * 40 + "a", "a"), (500, 1, "é" * 32, "z" * 64), (500, 1, "é" * 32, "z" * 65)]
    rows += [(777, 1, "user", "again")] * 30 + [(700, 0, "user", "t" * 300_000)] + [rows[7]] * 2
    return rows


@pytest.mark.parametrize("bits", [None, 3])
def test_trie_equals_the_loop(spark, monkeypatch, bits):
    if bits:                          # many small blocks, chunks and groups
        for name in ("BLOCK_BITS", "CHUNK_BITS", "SUM_BITS", "ID_BITS", "SIBLING_BITS"):
            monkeypatch.setattr(prefix_trie, name, bits - (name == "CHUNK_BITS"))
    rows = odd()
    assert got(frame(spark, rows)) == brute(rows)


def test_given_conversations(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    want = brute(con.execute("select conv_id, turn, role, text from conversations").fetchall())
    assert got(df) == want
    res = con.execute(ORACLE["op11_prefix_trie"])
    assert [d[0] for d in res.description] == prefix_trie.prefix_trie(df).columns
    assert sorted(res.fetchall(), key=lambda r: r[:2]) == want


def test_one_hot_conversation_and_no_conversation(spark, monkeypatch):
    """A conversation of many turns is one path over many blocks and chunks."""
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 4)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 5)
    rows = [(1, t, "user", str(t % 3)) for t in range(150)] + [(2, 0, "user", "0"), (3, 0, "user", "0")]
    assert got(frame(spark, rows, 8)) == brute(rows)
    assert prefix_trie.prefix_trie(frame(spark, rows).where("false")).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_contraction_and_ranks(spark):
    """A shuffled list is ranked whatever its blocks; contraction alone keeps every arc and link."""
    rnd = np.random.default_rng(3)
    order = rnd.permutation(5_000) * 7
    nxt = np.append(order[1:], -1)
    pdf = pd.DataFrame({"arc": order, "next": nxt, "leaf": np.arange(5_000), "saved": 1})
    out = prefix_trie.contract(pdf[pdf["arc"] % 2 == 0])
    mine = out.set_index("arc")
    follows = dict(zip(order, nxt))
    for a in mine.index:
        n = follows[a]
        if n in mine.index:
            assert mine["head"][n] == mine["head"][a] and mine["place"][n] == mine["place"][a] + 1
        else:
            assert mine["after"][mine["head"][a]] == n and mine["length"][mine["head"][a]] == mine["place"][a] + 1
    ranked = prefix_trie.list_rank(spark.createDataFrame(pdf).repartition(4))
    assert {r.arc: r.pos for r in ranked.collect()} == {int(a): i for i, a in enumerate(order)}
    sums = prefix_trie.prefix_sums(ranked, ["leaf"]).orderBy("pos").collect()
    assert [r.sum_leaf for r in sums] == np.cumsum(np.arange(5_000)).tolist()
