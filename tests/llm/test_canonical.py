import random

from scriptorium.llm.canonical import HELD, NEAR, BKTree, Matcher, levenshtein, map_to_list

TERMS = [(1, "Contextual Curriculum Framework"), (2, "Contextual Curriculum Dashboard"), (3, "Secure Payroll Monitor"), (4, "双语版采购网关"), (5, None)]


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_and_tree_against_brute_force():
    rng = random.Random(1)
    some = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(120)]
    tree = BKTree()
    for k, x in enumerate(some):
        tree.add(x, k)
    for q in some[:30]:
        assert all(levenshtein(q, x) == slow(q, x) for x in some)
        got = {k for _, ids in tree.near(q, 2) for k in ids}
        assert got == {k for k, x in enumerate(some) if slow(q, x) <= 2}


def test_many_values_at_once_are_measured_like_one():
    rng = random.Random(2)
    some = ["".join(rng.choice("abc数据é") for _ in range(rng.choice((0, 1, 5, 9, 70)))) for _ in range(60)]
    tree = BKTree()
    for k, x in enumerate(some):
        tree.add(x, k)
    asked = [*some[:20], "", "zz", "abca", "数" * 80, some[-1][:-1] + "x"]
    within = [rng.randrange(0, 6) for _ in asked]
    for q, r, found in zip(asked, within, tree.near_all(asked, within)):
        assert {(d, k) for d, ids in found for k in ids} == {(slow(q, x), k) for k, x in enumerate(some) if slow(q, x) <= r}


def test_stages_do_not_tie_over_shards():
    one = Matcher([(1, "数据治理"), (2, "数据治理规范书")])
    assert one.find("数据治理规范") == (HELD, {1})
    assert min(Matcher([(k, t)]).find("数据治理规范") for k, t in ((1, "数据治理"), (2, "数据治理规范书"))) == (HELD, {1})
    assert Matcher([(2, "数据治理规范书")]).find("数据治理规范") == (NEAR + 1, {2})


def typed(spark, values, **kw):
    df = spark.createDataFrame([(v, "x") for v in values], "value string, form string")
    terms = spark.createDataFrame([(i, t, "y") for i, t in TERMS], "term_id long, term string, value string")
    return {r["value"]: r["term_id"] for r in map_to_list(df, terms, **kw).collect()}


CASES = {
    "contextual curriculum framework": 1, "Framework, Contextual Curriculum": 1, "CONTEXTUAL_CURRICULUM_DASHBOARD": 2, "Contextual Curiculum Framewrok": 1,
    "Secure Payroll Monitors": 3, "SPM": 3, "S.P.M.": 3, "Secu. Payr. Monitor": 3, "our Secure Payroll Monitor (pilot)": 3, "Payroll Monitor": 3,
    "Sеcure Payroll Monitor": 3, "双语版采购网关V2": 4, "双语版的采购网关": 4, "语版采购网关": 4, "Contextual Curriculum": -1, "Tidal Harpoon Guild": -1, "": -1, " ": -1, "?": -1,
    "x" * 3000: -1,
}


def test_typed_values(spark):
    assert typed(spark, [*CASES, None, "SPM"]) == CASES


def test_shards_agree_and_empty_lists(spark):
    assert typed(spark, list(CASES), shard_terms=2) == CASES
    df = spark.createDataFrame([("a",)], "value string")
    none = spark.createDataFrame([], "term_id long, term string")
    assert [tuple(r) for r in map_to_list(df, none).collect()] == [("a", -1)]
    assert map_to_list(df.limit(0), spark.createDataFrame([(1, "a")], "term_id long, term string")).collect() == []
