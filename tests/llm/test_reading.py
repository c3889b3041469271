import random

import numpy as np

from scriptorium.llm import reading

EASY = ["The dog has a hat.", "She buys bread.", "We like the park.", "He sees a red car."]
MIDDLE = ["The planning unit measured the guide and approved the schedule within ten days.", "Most users noticed no difference after the audit team had revised the catalogue."]
HARD = ["Concomitant with institutional hybridisation, multidimensional verifiability corroborates irreducible categorisation across longitudinal ontologies, whereby infrastructural interoperability encapsulates the traceability of paradigmatic configurations."]
BANDS = {"easy": EASY, "middle": MIDDLE, "hard": HARD}


def table(spark):
    rng = random.Random(3)
    docs, labels, truth = [], [], {}
    for k in range(240):
        band = ("easy", "middle", "hard")[k % 3]
        text = "# Title\n\n" + " ".join(rng.choice(BANDS[band]) for _ in range(12))
        docs.append((k, text, f"s{k % 4}", "x"))
        truth[k] = band
        if k % 2:
            labels.append((k, band if k % 31 else "easy", "p"))
    docs += [(900, None, None, "x"), (901, "", None, "x"), (902, "- - -", "s1", "x"), (None, "a b", "s1", "x"), docs[0], (903, "the dog sees a hat. " * 20_000, "s1", "x")]
    labels += [(1, None, "p"), (3, "easy", "q"), (3, "hard", "r"), (None, "hard", "r"), (5, "odd", "q"), labels[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, x string"), spark.createDataFrame(labels, "doc_id long, band string, annotator string"), truth


def test_levels(spark):
    docs, labels, truth = table(spark)
    levels, grader = reading.reading_levels(docs, labels)
    got = {r["doc_id"]: r["band"] for r in levels.collect()}
    assert set(got) == set(truth) | {903}
    assert np.mean([got[k] == truth[k] for k in truth]) > 0.97
    assert set(grader.accuracy) == {"s1", "s3"} and min(a for _, a, _ in grader.accuracy.values()) > 0.8
    assert max(e for _, _, e in grader.accuracy.values()) < 0.3


def test_calibration_is_the_rising_curve_nearest_to_the_labels():
    rng = np.random.default_rng(1)
    g = np.sort(rng.uniform(0, 2, 60))
    y = np.clip(np.round(g + rng.normal(0, 0.6, 60)), 0, 2)
    c = reading.Calibration().fit(g, y)
    assert np.all(np.diff(c(g)) >= 0) and np.all(np.diff(c.means) > 0)
    # the greatest of the least means over all ranges is the isotonic fit, brute force
    want = [max(min(y[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(c.means, 9))


def test_no_labels_and_no_documents(spark):
    docs, labels, _ = table(spark)
    levels, grader = reading.reading_levels(docs, labels.limit(0))
    assert grader is None and {r["band"] for r in levels.collect()} == {"middle"}
    assert reading.reading_levels(docs.limit(0), labels)[0].collect() == []


def test_trees_follow_a_curve():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (600, 3))
    y = np.sign(x[:, 0]) + x[:, 1] ** 2
    t = reading.Trees().fit(x[:400], y[:400])
    assert np.mean((t.predict(x[400:]) - y[400:]) ** 2) < 0.05 * y.var()
