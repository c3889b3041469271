import itertools
import random

import numpy as np
import pytest

from scriptorium.llm import neardup, wordrun
from scriptorium.llm.wordrun import words


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)] + list("编目检索报告")
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 3)):
            edited = list(base)
            for _ in range(rng.randrange(1, 9)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
    texts += [texts[0].upper(), "**" + texts[1].replace(" ", ",  ") + "**", "", " ", "one two", None, texts[2] * 200]
    return list(enumerate(texts))


@pytest.mark.parametrize("block_rows", [2_000, 2])
def test_all_pairs_against_brute_force(spark, rows, monkeypatch, block_rows):
    data = corpus()
    df = spark.createDataFrame([(*x, "c") for x in data + data[:5] + [(None, "a b c d")]], "struct_id long, content_md string, fp string")
    monkeypatch.setattr(neardup.candidate_pairs, "__defaults__", (block_rows, 0))
    links, members = neardup.near_texts(df, "struct_id", "content_md", 3, 0.55, False)
    sets = {i: set(neardup.runs(t).tolist()) for i, t in data if t and len(words(t)) >= 3}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    got = set(rows(neardup.all_pairs(links, members)))
    # bands may miss a pair just above the threshold, nothing beyond 0.7, and give no pair below it
    assert {p for p, s in share.items() if s >= 0.7} <= got <= {p for p, s in share.items() if s > 0.55} and len(got) > 30
    exact = neardup.near_texts(df, "struct_id", "content_md", 3, 0.2, False, exact=True)
    assert set(rows(neardup.all_pairs(*exact))) == {p for p, s in share.items() if s > 0.2}


def test_empty(spark, rows):
    links, members = neardup.near_texts(spark.createDataFrame([], "struct_id long, content_md string"), "struct_id", "content_md")
    assert rows(links) == [] and rows(members) == []


def test_pivots_discard_no_pair_within_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (8, 4)).astype(np.uint64)
    fp = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (8, 4)).astype(np.uint64)) for _ in range(12)])
    key = np.sort(rng.integers(0, 6, len(fp)))
    ids = np.arange(len(fp))
    a, b = neardup._block_pairs(key, ids, np.full(len(fp), 2), fp, 20)
    want = {(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if key[i] == key[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 20}
    assert set(zip(a.tolist(), b.tolist())) == want and want


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_word_hashes_are_those_of_the_words(monkeypatch, size):
    monkeypatch.setattr(wordrun, "_PIECE", size)
    texts = ["", " ", "one", "One, two_THREE 4", "年 编目检索report报告", "ＡＢＣ a\u200bb é\u0301x 𝒳y 𠀀z", "tail-", "-head", "x" * 6, "İstanbul straße", *(t for _, t in corpus() if t)]
    by = {}
    for t in texts:
        w, h = words(t), wordrun.word_hashes(t).tolist()
        if max(map(len, w), default=0) < size:
            assert len(w) == len(h), t
            for a, b in zip(w, h):
                assert by.setdefault(a, b) == b
    assert len(set(by.values())) == len(by)
