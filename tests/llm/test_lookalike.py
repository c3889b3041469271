import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.lookalike import Looks, look_classes, same_look

U = Looks.universal()


def test_what_looks_the_same():
    same = [("Ａｂｃ", "Abc"), ("café", "café"), ("a​b", "ab"), ("a b", "a b"), ("раураl", "paypal"), ("ⅳ", "iv"), ("⼯作", "工作"), ("x‑y", "x-y"), ("\tx", " x"), ("ﬁn", "fin"), ("ё", "ë")]
    for a, b in same:
        assert U.rewrite(a) == U.rewrite(b), (a, b)
    for a, b in [("abc", "Abc"), ("cafe", "café"), ("a b", "a  b"), ("l", "I"), ("O", "0"), ("rn", "m"), ("x²", "x2"), ("'", '"')]:
        assert U.rewrite(a) != U.rewrite(b), (a, b)


def test_ascii_never_merges():
    plain = [chr(k) for k in range(32, 127)]
    assert len({U.rewrite(x) for x in plain}) == len(plain) and all(U.rewrite(x) == x for x in plain)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_rewriting_twice_changes_nothing(text):
    assert U.rewrite(U.rewrite(text)) == U.rewrite(text)


def test_pairs_against_brute_force(spark, rows):
    values = ["abc", "аbc", "abc", "ABC", "ａbc", None, " ", "​", "　", "", "x y", "x y", "x" * 5000, "х" + "x" * 4999]
    data = [("g", f"k{k}", v) for k, v in enumerate(values)] + [("h", "k0", "abc"), ("g", None, "abc"), ("g", "k0", "abc")]
    df = spark.createDataFrame([(*r, "z") for r in data], "field string, key string, value string, _c string")
    got = rows(same_look(df, ["field"]))
    kept = [(k, v) for k, v in ((f"k{k}", v) for k, v in enumerate(values)) if v is not None and U.rewrite(v).strip()]
    want = {("g", *sorted((a[0], b[0]))) for a, b in itertools.combinations(kept, 2) if a[1] != b[1] and U.rewrite(a[1]) == U.rewrite(b[1])}
    assert got == sorted(want)
    classes = rows(look_classes(df, ["field"]).select("key", "class_key", "strings", "links"))
    of = lambda k: [b if a == k else a for _, a, b in want if k in (a, b)]
    text = dict(kept)
    assert classes == sorted((k, min(x for x, v in kept if U.rewrite(v) == U.rewrite(text[k])), len({text[k], *(text[x] for x in of(k))}), len(of(k))) for k, _ in kept if of(k))
    assert rows(look_classes(df.limit(0), ["field"])) == []
    assert rows(same_look(df.limit(0), ["field"])) == []


def test_the_most_frequent_member_stands_for_its_class():
    looks = Looks({"а": 5, "a": 2, "Ａ": 9, "A": 9, "​": 3, "　": 4}, ascii_first=False)
    assert looks.rewrite("a") == looks.rewrite("а") == "а" and looks.rewrite("Ａ") == "A" and looks.rewrite("x​　y") == "x y"
    assert Looks({"а": 5, "a": 2}).rewrite("а") == "a"
    looks = Looks({"ﬁ": 9, "f": 1, "i": 1, "і": 4, "ⅳ": 3, "㈱": 2}, ascii_first=False)
    assert looks.rewrite("ﬁ") == looks.rewrite("fi") == looks.rewrite("fі") and looks.rewrite("ⅳ") == looks.rewrite("іv") and looks.rewrite("㈱") == looks.rewrite("(株)")
