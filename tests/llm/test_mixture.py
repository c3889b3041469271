import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import mixture


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 60))
def test_fit_is_the_best_total_below_the_budget(sizes, budget):
    lengths, counts = np.asarray(sorted(sizes)), np.asarray([sizes[k] for k in sorted(sizes)])
    rounds, take = mixture.fit(lengths, counts, budget)
    total = int((lengths * counts).sum())
    rest = budget % total
    best = max(t for c in itertools.product(*[range(n + 1) for n in counts]) if (t := int((lengths * np.asarray(c)).sum())) <= rest)
    assert rounds == budget // total and (take <= counts).all() and int((take * lengths).sum()) == best


def test_large_budgets_come_close():
    lengths, counts = np.arange(50, 3000), np.full(2950, 400)
    total = int((lengths * counts).sum())
    _, take = mixture.fit(lengths, counts, total // 3)
    assert (take <= counts).all() and total // 3 - int((take * lengths).sum()) == 0


def data(spark):
    docs = [(k, "word " * (1 + k % 7), ["Wiki-Articles", "tickets", "other", None, " TICKETS "][k % 5], "x") for k in range(200)]
    docs += [(500, None, "tickets", "x"), (501, "", "tickets", "x"), (None, "a b", "tickets", "x"), docs[0], docs[1]]
    weights = [("wiki_articles", 0.5, 3), ("tickets", 0.3, 1), ("manuals", 0.2, 2), (None, 0.1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens string"), spark.createDataFrame(weights, "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixture, "BUCKET_ROWS", bucket)
    docs, weights = data(spark)
    chosen, report = mixture.mix(docs, weights)
    rows = chosen.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    limit = {"wiki_articles": 3, "tickets": 1}
    assert all(1 <= r["repeats"] <= limit[r["source"]] for r in rows)
    said = {r["source"]: r for r in report.collect()}
    for s in limit:
        used = sum(r["n_tokens"] * r["repeats"] for r in rows if r["source"] == s)
        assert used == said[s]["actual_tokens"] and 0 <= said[s]["target_tokens"] - used <= 7
    assert said["manuals"]["actual_tokens"] == 0 and abs(sum(r["actual_share"] for r in said.values()) - 1) < 1e-6
    again = {tuple(r) for r in mixture.mix(docs.repartition(7), weights)[0].collect()}
    assert again == {tuple(r) for r in rows}


def test_empty_and_total(spark):
    docs, weights = data(spark)
    chosen, report = mixture.mix(docs.limit(0), weights)
    assert chosen.collect() == [] and {r["actual_tokens"] for r in report.collect()} == {0}
    small, report = mixture.mix(docs, weights, total=50)
    assert sum(r["actual_tokens"] for r in report.collect()) <= 50
