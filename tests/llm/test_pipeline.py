"""Every stage of the pipeline against plain loops, and the stages together."""

import collections

import corpus_pipeline as P

from ..conftest import SF
from .test_counts import measures, targets
from .test_text_search import WORD, components, contamination


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    start = rows(docs)

    def good(text):
        m = measures(text)
        return m[0] >= 50 and 100 * m[4] <= 50 * m[0]

    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    one = P.materialize(P.quality_rules(spark, docs, SF), "t")
    assert one.columns == docs.columns and rows(one) == collections.Counter({r: n for r, n in start.items() if good(r[1])})

    two = P.materialize(P.near_duplicates(spark, one, SF), "t")
    pairs = [(r[0], r[1]) for r in rows(one)]
    want = {c for _, _, c in components(pairs, 5, 80, 100)}
    assert two.columns == docs.columns and {r[0] for r in rows(two)} == want and len(want) < len(pairs)

    three = P.materialize(P.decontamination(spark, two, SF), "t")
    hit = {k[0] for k in contamination([(r[0], r[1]) for r in rows(two)], bench) if k[-1]}
    assert three.columns == docs.columns and {r[0] for r in rows(three)} == want - hit and hit

    four = P.materialize(P.mixing(spark, three, SF), "t")
    assert four.columns == docs.columns and set(rows(four)) <= set(rows(three)) and max(rows(four).values()) <= 3
    at = docs.columns.index("source")
    size, target = targets([(r[at], len(WORD.findall(r[1]))) for r in rows(three)])
    taken = collections.Counter()
    for r, n in rows(four).items():
        taken[r[at]] += n * len(WORD.findall(r[1]))
    largest = max(len(WORD.findall(r[1])) for r in rows(three))
    assert all(abs(taken[s] - target[s]) <= largest for s in size)

    five = P.sharding(spark, four, SF).collect()
    assert collections.Counter(r.doc_id for r in five) == collections.Counter(r[0] for r in rows(four).elements())
    slots = collections.defaultdict(list)
    for r in five:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    run = P.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.shard) for r in run) == collections.Counter((r.doc_id, r.shard) for r in five)


def test_odd_documents(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows_ = [(1, words, "en", "a", 3, "x"), (1, words, "en", "a", 3, "x"), (None, words + " z", None, None, None, None),
             (2, None, None, None, None, None), (3, "", "en", "a", 0, "x"), (4, words.replace("w", "v"), "en", None, 1, "y")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    for _, stage in P.STAGES:
        df = P.materialize(stage(spark, df, SF), "t")
    got = collections.Counter(r.doc_id for r in df.collect())
    assert set(got) <= {1, None, 4} and 2 not in got and 3 not in got


def test_empty(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        df = P.materialize(stage(spark, df, SF), "t")
        assert df.count() == 0
