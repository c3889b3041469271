import random

from scriptorium.llm.leakage import Leaks, SuffixAutomaton, leaks, removed

WORDS = [f"t{k}" for k in range(60)]
RNG = random.Random(2)
ITEM = [" ".join(RNG.choice(WORDS) for _ in range(30)) for _ in range(6)]
ITEM[3] = " ".join(ITEM[0].split()[:14] + ITEM[3].split()[:16])
ZH = "".join(RNG.choice("灯塔石桥河岸旧船木桨铜铃") for _ in range(60))


def test_automaton_against_brute_force():
    rng = random.Random(5)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(0, 25))] for _ in range(6)]
    auto = SuffixAutomaton(sequences)
    stream = [rng.randrange(4) for _ in range(120)]
    found = {at: (state, n) for at, state, n in auto.stream(stream, 1)}
    for at in range(len(stream)):
        best = 0
        for n in range(1, at + 2):
            part = stream[at + 1 - n : at + 1]
            if any(part == s[k : k + n] for s in sequences for k in range(len(s) - n + 1)):
                best = n
        assert (found[at][1] if at in found else 0) == best
        if best:
            part = stream[at + 1 - best : at + 1]
            want = {(s, k + best - 1) for s, q in enumerate(sequences) for k in range(len(q) - best + 1) if q[k : k + best] == part}
            assert set(auto.positions(found[at][0])) == want


def brute(doc, item, least=8):
    d, t = doc.split(), item.split()
    held = set()
    for i in range(len(d)):
        for j in range(len(t)):
            n = 0
            while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n]:
                n += 1
            if n >= least:
                held |= set(range(j, j + n))
    return len(held)


def test_coverage_against_brute_force():
    rng = random.Random(9)
    lk = Leaks(list(enumerate(ITEM)))
    docs = []
    for _ in range(60):
        w = [rng.choice(WORDS) for _ in range(40)]
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(ITEM).split()
            a = rng.randrange(len(part))
            w[10:10] = part[a : a + rng.randrange(4, 20)]
        docs.append(" ".join(w))
    got = {(k, i): n for k, codes, _ in lk.screen(docs) for i, n, _ in lk.leaked(codes)}
    want = {(k, i): n for k, x in enumerate(docs) for i, t in enumerate(ITEM) if (n := brute(x, t)) >= 0.4 * 30}
    assert got == want and len(want) > 5


def tables(spark):
    marked = "**" + ITEM[0].replace(" t", ",\n​T")[:90] + "** <b>x</b>"
    docs = [(1, "# head\n\n" + ITEM[1] + "\n\nend", "e"), (2, None, "e"), (3, "", "e"), (4, marked, "e"), (5, "前言" + ZH[:40] + "后记", "e"), (6, ZH[:11] + "词" + ZH[30:41], "e"), (7, ITEM[1], "e"), (7, ITEM[1], "e"), (None, ITEM[1], "e"), (8, "w " * 40_000 + ITEM[2], "e")]
    items = [(10 + k, t, "x") for k, t in enumerate(ITEM)] + [(30, ZH, "x"), (31, None, "x"), (32, "", "x"), (33, "too short", "x"), (None, "y", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")


def test_documents(spark, rows):
    docs, items = tables(spark)
    want = [(1, 11), (4, 10), (4, 13), (5, 30), (7, 11), (8, 12)]  # item 13 begins as item 10 does
    assert rows(leaks(docs, items).select("doc_id", "item_id")) == want
    assert rows(leaks(docs, items, shard_bytes=100).select("doc_id", "item_id")) == want
    assert rows(leaks(docs, items.limit(0))) == [] and rows(leaks(docs.limit(0), items)) == []


def test_spans_are_removed(spark):
    docs, items = tables(spark)
    got = {r["doc_id"]: r for r in removed(docs, items).collect()}
    assert got == {r["doc_id"]: r for r in removed(docs, items, shard_bytes=100).collect()}
    assert removed(docs, items.limit(0)).collect() == [] and removed(docs.limit(0), items).collect() == []
    assert sorted(got) == [1, 4, 5, 7, 8] and got[1]["cleaned"] == "head end" and got[7]["words_left"] == 0 and got[8]["words_removed"] == 30
