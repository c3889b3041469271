import itertools

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import filenames, history, neardup
from scriptorium.llm.lookalike import Looks

U = Looks.universal()
A = "Milimi Lonahe Visitor Access Minutes 2015 Part 1.pdf"
SAME = [A, "Visitor Access Minutes Milimi Lonahe 2015 Part 1.docx", "milimi_lonahe_visitor_access_minutes_2015_part_1.txt", "Copy of Milimi%20Lonahe%20Visitor%20Access%20Minutes%202015%20Part%201 (2).md",
        "RE Milmi Lonahe Visitor Access Minutes 2015 Part 1_v2_final.pdf", "Milimi Lonahe Visitor Acecss Minutes 2015 Part 1 - Copy.pdf", "Ｍｉｌｉｍｉ Lоnahe Visitor Access Minutes 2015 Part 1 .pdf"]
OTHER = ["Milimi Lonahe Visitor Access Minutes 2016 Part 1.pdf", "Milimi Lonahe Visitor Access Minutes 2015 Part 7.pdf", "Milimi Lonahe Visitor Access Minutes 2015.pdf",
         "Milimi Lonahe Visitor Access Report 2015 Part 1.pdf", "Goroki Sosazi Visitor Access Minutes 2015 Part 1.pdf", "Milimi Lonahe Meal Ordering Minutes 2015 Part 1.pdf"]
SLIPS = [("Tizoyi Modako Exam Scheduling Handbook 2016.md", "Tizoyi Modako Eam Scheduling Handbook 2016.md"), ("Goyaso Zapame Bus Routing Policy 2017.md", "Goyayo Zapae Bus Routing Policy 2017.md")]
ZH = ["石岚火立兰米薪酬复核评审2021.xlsx", "薪酬复核评审石岚火立兰米2021_V3.pdf", "转发石岚火立兰米薪酬复核（评审）2021终稿.docx"]


def near(a, b):
    return filenames.same(filenames.normal(a, U), filenames.normal(b, U))


def test_names():
    assert all(near(A, b) for b in SAME) and not any(near(A, b) for b in OTHER)
    assert all(near(ZH[0], b) for b in ZH) and not near(ZH[0], "石岚火立兰米薪酬复核评审2022.xlsx") and not near(ZH[0], "石岚火立兰米薪酬复核合同2021.xlsx")


def test_slips():
    for a, b in SLIPS:
        assert near(a, b) and set(filenames.keys(filenames.normal(a, U))) & set(filenames.keys(filenames.normal(b, U)))
        assert filenames.covers(filenames.normal(a, U), filenames.normal(b, U))
    assert not near("A Big Report Phase II.md", "A Big Report Phase III.md") and not near("A Big Report Phase VII.md", "A Big Report Phase III.md")


SHORT = [("budget 2021", "bugdet 2021"), ("annual budget 2021", "anual bugdet 2021"), ("water budget plan", "watr bugdet plan"), ("budget", "budgets"),
         ("interoperabilities 3", "interoperabiltiies 3"), ("internationa", "international"), ("a bb report", "a bb reprot"), ("one report plan budget", "one reprot plan bugdet")]


@pytest.mark.parametrize("a, b", SHORT)
def test_short_forms_share_a_key(a, b):
    a, b = filenames.normal(a, U), filenames.normal(b, U)
    assert filenames.same(a, b) and set(filenames.keys(a)) & set(filenames.keys(b)) and filenames.covers(a, b)


def test_names_that_are_the_same_share_a_key():
    forms = {filenames.normal(x, U) for x in SAME + OTHER + ZH}
    for a, b in itertools.combinations(forms, 2):
        if filenames.same(a, b):
            assert set(filenames.keys(a)) & set(filenames.keys(b)) and filenames.covers(a, b), (a, b)


@pytest.mark.parametrize("x", ["", ".", "...", ".pdf", "copy.txt", "(1)", "a", "年", "​", "x" * 5000, "词" * 3000])
def test_odd_names_have_a_form(x):
    form = filenames.normal(x, U)
    assert isinstance(form, str) and (not form or list(filenames.keys(form)))


H = "ab" * 32


def uploads(spark):
    rows = [(k, n, None, b) for k, (n, b) in enumerate([*zip(SAME, [0, 0, 1, 1, 2, 2, 2]), *zip(OTHER, [0] * 6)])]
    rows += [(20, None, H, 0), (21, "Zazu Zozo Other Thing 1999.md", "sha256: " + H.upper(), 1), (22, "Kaku Koko Lolo 2001.txt", H[:16], 2), (23, "x.md", "pending", 2), (24, "y.md", "pending", 2), (25, None, None, None), (None, "z.md", H, 1)]
    rows += rows[:3]
    return spark.createDataFrame([(*r, "c") for r in rows], "upload_id long, original_filename string, sha256 string, batch_id long, fp string")


WANT = [(0, k) for k in range(1, 7)] + [(20, 21), (20, 22)]


def test_batches_against_what_is_known(spark, rows):
    store = history.check_batches(uploads(spark))
    assert rows(store.repeats()) == sorted(WANT)


def test_a_star_for_the_first_of_each_key(spark, rows):
    _, stars = history.fingerprints(uploads(spark))
    assert (0, 1, 0) in rows(stars) and (20, 22, 0) in rows(stars)


def test_reopened_overfull_and_merged(spark, rows, tmp_path):
    """Filters that are full only cost time, a store that is opened again goes on, what a broken batch left is overwritten."""
    path = str(tmp_path / "s")
    data = uploads(spark)
    store = history.FingerprintStore(spark, path, parts=2, part_bits=64, tier=2, chunk=1)
    store.absorb(*history.fingerprints(data.where("upload_id % 3 = 0")))
    again = history.FingerprintStore(spark, path, parts=7, tier=2, chunk=1)
    assert (again.turn, again.parts, again.part_bits) == (1, 2, 64)
    again.absorb(*history.fingerprints(data.where("upload_id % 3 = 1")))
    broken = history.FingerprintStore(spark, path, tier=2)
    broken._commit = lambda: None
    broken.absorb(*history.fingerprints(data.where("upload_id = 12")))
    last = history.FingerprintStore(spark, path, tier=2, chunk=1)
    assert last.turn == 2 and [t for _, t in last.runs] == [1]
    last.absorb(*history.fingerprints(data.where("upload_id % 3 = 2")))
    assert rows(last.repeats()) == rows(history.FingerprintStore(spark, path).repeats()) == sorted(WANT)


def test_a_batch_touches_only_its_parts(spark, tmp_path):
    store = history.FingerprintStore(spark, str(tmp_path / "s"), parts=512)
    store.absorb(*history.fingerprints(uploads(spark)))
    before, history_rows = dict(store.filters), store._rows(store.runs[0][0]).count()
    read = []
    rows_of = store._rows

    def counted(*runs):
        df = rows_of(*runs)
        return df if runs == ("1",) else type("Read", (), {"where": lambda _, c: (read.append(df.where(c).count()), df.where(c))[1]})()

    store._rows = counted
    store.absorb(*history.fingerprints(spark.createDataFrame([(90, "zz.md", H)], "upload_id long, original_filename string, sha256 string")))
    changed = [p for p in store.filters if store.filters[p] != before.get(p)]
    assert len(changed) <= 6 and sum(read) < history_rows / 10


def test_a_hot_fingerprint_is_compared_in_chunks(spark, rows, tmp_path):
    names = [f"Milimi {a}onahe {b}isitor Access Minutes 2015 Part 1.pdf" for a in "bcdfg" for b in "klmnp"]
    data = spark.createDataFrame([(k, n, None) for k, n in enumerate(names)], "upload_id long, original_filename string, sha256 string")
    found = [rows(history.FingerprintStore(spark, str(tmp_path / str(c)), chunk=c).absorb(*history.fingerprints(data))) for c in (3, 2_000)]
    assert found[0] == found[1] and len(found[0]) == 25 * 24 // 2


def test_batches_that_wait_are_absorbed_in_one_turn(spark, rows):
    store = history.check_batches(uploads(spark))
    assert store.turn == 2 and rows(store.repeats()) == sorted(WANT)


def test_forms_under_a_hot_fingerprint_meet_by_the_words_left_out(spark, rows, tmp_path, monkeypatch):
    words = ["".join(x) for x in zip("bdfgklmnprst" * 5, "aeiou" * 12, "kmtzvrb" * 9, "oeuia" * 12, "dnslgpf" * 9, "eioau" * 12)]
    names = [f"{a} {b}xolum Payroll Review Plan 2015.pdf" for a, b in zip(words, words[7:] + words[:7])]
    names.append(names[3].replace("xolum", "xolm").replace(words[3], words[3][1:]))  # a slip in each of two words
    data = spark.createDataFrame([(k, n, None) for k, n in enumerate(names)], "upload_id long, original_filename string, sha256 string")
    both = history.fingerprints(data)
    found = rows(history.FingerprintStore(spark, str(tmp_path / "s")).absorb(*both))
    assert (3, len(words)) in found
    monkeypatch.setattr(history, "_verified", lambda a, b: F.lit(True))  # all pairs that meet
    met = rows(history.FingerprintStore(spark, str(tmp_path / "t")).absorb(*both))
    assert set(found) <= set(met) and len(met) < len(words) * (len(words) - 1) / 2 / 3


def test_same_forms_share_a_split_under_a_shared_key():
    base = ["monani", "toyage", "payroll", "review", "plan", "2015"]
    slips = lambda w: [w[1:], w[:-2] + w[-1], w[1] + w[0] + w[2:], "z" + w, w[:2] + "q" + w[3:]]
    for x in range(5):
        for y in range(x, 5):
            for p, q in zip(slips(base[x]), reversed(slips(base[y]))):
                other = list(base)
                other[x], other[y] = (p, p) if x == y else (p, q)
                a, b = " ".join(sorted(base)), " ".join(sorted(other))
                if filenames.same(a, b):
                    shared = set(filenames.keys(a)) & set(filenames.keys(b))
                    assert any(set(filenames.splits(a, k)) & set(filenames.splits(b, k)) for k in shared)


def test_empty_history(spark, rows):
    assert rows(history.check_batches(uploads(spark).limit(0)).repeats()) == []


def test_name_groups(spark, rows):
    got = neardup.name_groups(uploads(spark), "upload_id", "original_filename")
    assert {r["id"] for r in got.where("rep = 0").collect()} == set(range(7))
