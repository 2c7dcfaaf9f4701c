import os

import pytest

from carex.llm import mixing as M, tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(T.TOKENIZERS, T.VOCABULARY)), reason="no vocabulary files here")
DOCS, TARGETS = "doc_id long, text string, source string, rate double, times int", "source string, target_share double, max_repeats double"


def docs(spark, spec):
    rows, n = [], 0
    for source, count, words in spec:
        for _ in range(count):
            rows.append((n, " the" * words if words is not None else None, source, 9.0, 9))
            n += 1
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_agreement_of_report_and_mixture(spark):
    d = docs(spark, [("big", 3000, 10), ("mid", 400, 5), ("small", 100, 10), (None, 50, 10), ("other", 50, 10)])
    t = spark.createDataFrame([("big", 0.5, 1.0), ("mid", 0.3, 4.0), ("small", 0.2, 2.5)], TARGETS)
    report = {r.source: r for r in M.mixture_report(d, t).collect()}
    assert report["small"].rate == pytest.approx(2.5) and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    for r in report.values():
        assert r.actual_share == pytest.approx(r.target_share, abs=0.04) and r.rate <= r.max_repeats
    rows = M.mixture(d, t).collect()
    by = {s: [r for r in rows if r.source == s] for s in report}
    assert {s: len(x) for s, x in by.items()} == {s: r.n_records for s, r in report.items()}
    assert max(r.copy_no for r in by["small"]) == 3 and min(r.copy_no for r in rows) == 1
    assert all(sum(x.doc_id == r.doc_id for x in by["small"]) in (2, 3) for r in by["small"])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mixture(d.repartition(7), t).collect()))


def test_sources_without_tokens_nulls_and_empty_tables(spark):
    d = docs(spark, [("a", 10, 5), ("empty", 3, None)])
    t = spark.createDataFrame([("a", 0.5, 1.0), ("empty", 0.3, 2.0), ("absent", 0.1, 1.0), (None, 0.1, 1.0), ("zero", 0.0, 1.0), ("void", None, 1.0)], TARGETS)
    report = {r.source: (r.rate, r.n_records, r.actual_share) for r in M.mixture_report(d, t).collect()}
    assert report == {"a": (1.0, 10, 1.0), "empty": (None, 0, 0.0), "absent": (None, 0, 0.0)}
    assert M.mixture(d, t).count() == 10
    assert M.mixture(d.limit(0), t).count() == 0 and M.mixture(d, t.limit(0)).count() == 0 and M.mixture_report(d, t.limit(0)).count() == 0
