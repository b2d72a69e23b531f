"""The filter audit against a plain loop over orders, steps and documents."""

import itertools
import re

import pytest

from spendwatch.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [(0, LONG, "en"), (1, LONG, "en"), (1, LONG, "en"), (2, LONG + " #", "de"), (3, "A B C", None), (4, None, "en"), (5, "", ""),
        (None, "", "en"), (None, None, None), (6, " \n\t", "de"), (7, "a " * 300, "en"), (8, "X" * 400_000, "en"),
        (9, LONG + "\u0085é|", "fr"), (10, LONG, "fr"), (11, "A b|", "en"), (12, "A b|", "en")] + [(20 + i, "copy copy", "en") for i in range(9)]
LABELS = [(0, 1, 0), (0, 0, 0), (1, 1, 1), (4, None, 1), (7, 0, 1), (12, 1, None), (None, 1, 1), (99, 1, 1), (12, 1, 0), (21, 1, 1)]


def fails(rows):
    out = []
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows)
        out.append({f for f, c in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)), copy)) if c})
    return out


def brute(rows, labels):
    bad, want = fails(rows), {}
    good = [any(i == d and d is not None and q == 1 for i, q, _ in labels) for d, _, _ in rows]
    toxic = [any(i == d and d is not None and x == 1 for i, _, x in labels) for d, _, _ in rows]
    for part in {lang or "" for _, _, lang in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shap = dict.fromkeys("ABCDE", 0)
        for o in itertools.permutations("ABCDE"):
            alive = list(mine)
            for k, f in enumerate(o):
                gone = [i for i in alive if f in bad[i]]
                alive = [i for i in alive if f not in bad[i]]
                shap[f] += len(gone)
                want[part, "".join(o), k + 1] = [
                    len(alive), len(gone), sum(f in bad[i] and bool(bad[i] & set(o[:k])) for i in mine),
                    sum(bad[i] == {f} for i in mine), sum(good[i] for i in gone), sum(toxic[i] for i in gone)]
        for (p, o, s), v in want.items():
            if p == part:
                v.append(shap[o[s - 1]])
    return want


@pytest.mark.parametrize("parts", [1, 5])
def test_audit_equals_the_loop(spark, parts):
    df = spark.createDataFrame([(*r, "x", 3) for r in ROWS], "doc_id long, text string, lang string, part string, mask int").repartition(parts)
    lab = spark.createDataFrame([(*r, "z") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit_filters(df, lab).collect()}
    assert got == brute(ROWS, LABELS)
    assert len(got) == 600 * 4


def test_no_documents_no_rows_and_no_labels_no_losses(spark):
    df = spark.createDataFrame([(1, "A", "en")], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(df.where("false"), lab).count() == 0
    rows = filter_audit.audit_filters(df, lab).collect()
    assert len(rows) == 600 and {r.good_lost + r.toxic_lost for r in rows} == {0}


def test_cells_stay_few(spark):
    """What the orders are folded over does not grow with the documents."""
    df = spark.range(500).selectExpr("id as doc_id", "concat('T ', id % 7) as text", "'en' as lang")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = filter_audit.masks(df, lab).groupBy("part", "mask").count().collect()
    assert len(cells) == 2 and sum(r["count"] for r in cells) == 500
