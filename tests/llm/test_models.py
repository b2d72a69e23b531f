"""Language profiles and the quality classifier against plain loops and held-out rows."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendwatch.llm import lang_id, quality_bayes
from spendwatch.llm.queries import REGISTRY

SF01 = "/root/testdata/sf0.01"
ODD = [None, "", " 12 3!", "a", "The the", "日本語 テキスト", "ß" * 100_000, "é\x00é", "x y z"]


def plain_trigrams(text):
    s = [0]
    for c in text:
        k = ord(c.lower()[0]) if c.isalpha() else 0
        if k or s[-1]:
            s.append(k)
    if s[-1]:
        s.append(0)
    return collections.Counter((a << 42 | b << 21 | c) for a, b, c in zip(s, s[1:], s[2:]) if b)


def test_trigrams_against_a_loop():
    texts = [t for t in ODD if t is not None] + ["", "Ab  c", "", "1a", "b-", "c d"]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    doc, tri, count = lang_id.trigrams(np.frombuffer(b"".join(raw), np.uint8), bounds)
    got = collections.defaultdict(collections.Counter)
    for d, t, c in zip(doc.tolist(), tri.tolist(), count.tolist()):
        got[d][t] = c
    assert [got[i] for i in range(len(texts))] == [plain_trigrams(t) for t in texts]
    bad = b"ab\xffcd"
    lang_id.trigrams(np.frombuffer(bad + b"ef", np.uint8), np.array([0, 5, 7]))


def bundle(text):
    def v(cp):
        return 1 - 2 * lang_id.letter_bits(np.array([cp]))[0].astype(int)

    out = np.zeros(lang_id.DIM)
    for t, c in plain_trigrams(text).items():
        out += c * (np.roll(v(t >> 42), 2) * np.roll(v(t >> 21 & (1 << 21) - 1), 1) * v(t & (1 << 21) - 1))
    return out


def bundles(texts):
    return np.concatenate([rows for _, rows in lang_id._bundles(pa.array(texts, pa.string()))])


def test_bundles_against_a_loop(monkeypatch):
    """Dense and sparse blocks, many texts, and long texts in pieces."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab cdé日本語ежз") for _ in range(rnd.randrange(60))) for _ in range(700)] + [None, ""]
    want = np.stack([bundle(t or "") for t in texts])
    for block, entries in ((1024, 4096), (3, 5), (64, 7)):
        monkeypatch.setattr(lang_id, "BLOCK", block)
        monkeypatch.setattr(lang_id, "ENTRIES", entries)
        assert np.array_equal(bundles(texts), want)
    monkeypatch.setattr(lang_id, "CHUNK", 11)
    assert np.array_equal(bundles(texts), want)


def test_letters_of_all_scripts_differ():
    letters = np.unique(lang_id._letter())
    assert len(letters) > 100_000
    packed = np.packbits(lang_id.letter_bits(letters[:40_000]), axis=1)
    assert len(np.unique(packed, axis=0)) == 40_000


def test_short_texts_of_many_scripts_stay_in_memory():
    """10,000 texts, all their trigrams different: no matrix of texts by trigrams."""
    import tracemalloc
    letters = np.unique(lang_id._letter())[1:]
    rnd = np.random.default_rng(1)
    texts = ["".join(map(chr, rnd.choice(letters[letters < 0xD000], 40))) for _ in range(10_000)]
    lang_id._letter()
    tracemalloc.start()
    n = sum(len(rows) for _, rows in lang_id._bundles(pa.array(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and peak < 200 << 20


def test_cosine_against_a_loop(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et la souris", "fr"),
                                                        ("that thing there", "en"), ("est une chose", "fr"), (None, "de"), ("x", None)])]
    df = spark.createDataFrame(rows + [(9, "the cat et le dog", None), (10, None, "en"), (11, "77", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang_id.predict(df, lang_id.learn(df.where("doc_id < 6"))).collect()}
    proto = {x: sum(bundle(t) for _, t, lang in rows if lang == x and t) for x in ("en", "fr")}
    proto = {k: v / np.linalg.norm(v) for k, v in proto.items()}
    mean = sum(proto.values()) / 2
    for i, t in [(0, rows[0][1]), (3, rows[3][1]), (9, "the cat et le dog")]:
        v = bundle(t) / np.linalg.norm(bundle(t)) - mean
        cos = {k: float(v @ (p - mean) / np.linalg.norm(v) / np.linalg.norm(p - mean)) for k, p in proto.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(max(cos[best], 0), abs=1e-4)
    assert got[10].lang_pred == got[11].lang_pred == "und" and got[10].score == 0


def test_held_out_accuracy(spark):
    rows = REGISTRY["op3_language_id"](spark, SF01).join(
        spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_learning_never_sees_held_out_rows(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet").limit(200)
    other = df.withColumn("lang", F.when(lang_id.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn(
        "text", F.when(lang_id.held_out(), F.lit("zzz zz zzz")).otherwise(F.col("text")))
    a, b = (lang_id.learn(x.where(~lang_id.held_out())) for x in (df, other))
    assert a.langs == b.langs and np.array_equal(a.proto, b.proto)


def test_odd_rows(spark):
    rows = [(i if i else None, t, "en" if i % 2 else None, "s", "clash") for i, t in enumerate(ODD)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    out = lang_id.predict(df, lang_id.learn(df)).collect()
    assert len(out) == len(rows)
    assert collections.Counter(r.lang_pred for r in out)["und"] == 6
    none = lang_id.predict(df, lang_id.learn(df.where("false"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert lang_id.predict(df.where("false"), lang_id.learn(df)).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 0), (77, 0, 0), (None, 0, 0)],
                                   "doc_id long, quality long, toxic long")
    out = quality_bayes.score_documents(df, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality_bayes.score_documents(df, labels.where("false")).collect()} == {0.5}
    assert quality_bayes.score_documents(df.where("false"), labels).count() == 0


def plain_features(text):
    out = set()
    for w in (text or "").replace("\n", " ").split(" "):
        if w:
            raw = w.encode()
            shape = 0
            for c in raw:
                shape |= int(quality_bayes._CLASS[c])
            out |= {("w", "".join(c.lower() if "A" <= c <= "Z" else c for c in w)),
                    ("s", shape, raw[-1] if quality_bayes._CLASS[raw[-1]] == 8 else 0)}
    return out


def curve(rows):
    """Slope and offset of the logistic curve through the rounded evidence, by small steps of plain descent."""
    bins = collections.defaultdict(list)
    for e, q in rows:
        bins[round(e * quality_bayes.BINS / (2 * quality_bayes.RANGE))].append((e, q))
    points = [(sum(e for e, _ in b) / len(b), q) for b in bins.values() for _, q in b]
    w = [0.0, 0.0]
    for _ in range(20_000):
        grad = [-1e-3 * w[0], -1e-3 * w[1]]
        for e, q in points:
            miss = q - 1 / (1 + math.exp(-(w[0] * e + w[1])))
            grad = [grad[0] + miss * e, grad[1] + miss]
        w = [w[0] + 0.2 * grad[0], w[1] + 0.1 * grad[1]]
    return w


def test_scores_against_a_loop(spark):
    """Evidence is the mean log ratio of the distinct words and shapes over the labels of the other folds (a vocabulary
    without hash collisions); the score is the curve through the labelled evidence, moved by the path's rate."""
    rnd = random.Random(3)
    vocabulary = ["the", "The", "cat!", "DOG", "été", "7up", "x,", "(y)", "a|b", "12", "Zz."]
    rows = [(i, " ".join(rnd.choices(vocabulary[i % 4:], k=rnd.randrange(9)))) for i in range(60)]
    rows += [(60, rows[0][1]), (61, None)]
    quality = {i: int(rnd.random() < (0.8 if i % 4 == 0 else 0.3)) for i in range(0, 62, 2)}
    docs = spark.createDataFrame([(d, t, "s", "en") for d, t in rows], "doc_id long, text string, source string, lang string")
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(quality_bayes.FOLDS)).alias("f")).collect()}
    assert fold[0] == fold[60] and len(set(fold.values())) == quality_bayes.FOLDS
    text, evidence = dict(rows), {}
    for k in range(quality_bayes.FOLDS):
        n, total = collections.defaultdict(lambda: [0, 0]), [0, 0]
        for d, q in quality.items():
            if fold[d] != k:
                total[1 - q] += 1
                for f in plain_features(text[d]):
                    n[f][1 - q] += 1
        ratio = {f: math.log((g + .5) / (total[0] + 1)) - math.log((b + .5) / (total[1] + 1)) for f, (g, b) in n.items()}
        for d in (d for d, j in fold.items() if j == k):
            fs = plain_features(text[d])
            evidence[d] = sum(ratio.get(f, 0) for f in fs) / max(len(fs), 1)
    slope, offset = curve([(evidence[d], q) for d, q in quality.items()])
    prior = (sum(quality.values()) + .5) / (len(quality) + 1)
    got = quality_bayes.score_documents(docs, spark.createDataFrame(list(quality.items()), "doc_id long, quality long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.evidence == pytest.approx(evidence[r.doc_id], abs=1e-5)
        odds = slope * r.evidence + offset + math.log(r.path_rate / (1 - r.path_rate)) - math.log(prior / (1 - prior))
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-3)


def test_evidence_does_not_know_its_own_label(spark):
    """Words that occur in one text only and random labels: evidence from the text's own label would tell them all."""
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "s", "en") for i in range(400)]
    labels = [(i, rnd.randrange(2)) for i in range(400)]
    out = quality_bayes.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"),
                                        spark.createDataFrame(labels, "doc_id long, quality long")).collect()
    quality = dict(labels)
    good, bad = ([r.score for r in out if quality[r.doc_id] == q] for q in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert 0.35 < auc < 0.65


def test_sparse_sites_keep_near_the_prior(spark):
    rows = [(i, f"word{i % 7} text", "big" if i < 400 else "tiny", "en") for i in range(402)]
    labels = [(i, int(i % 10 != 0)) for i in range(400)] + [(400, 0)]
    out = quality_bayes.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"),
                                        spark.createDataFrame(labels, "doc_id long, quality long")).collect()
    rate = {r.doc_id: r.path_rate for r in out}
    assert rate[0] == pytest.approx(0.9, abs=0.03) and 0.3 < rate[401] < 0.9


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    test = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    out = quality_bayes.score_documents(docs, labels.join(test, "doc_id", "left_anti")).join(test, "doc_id").collect()
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum(s >= 0.5 for s in good) >= 0.97 * len(good)
