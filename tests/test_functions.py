from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import evaluation as E
from recollect.functions import semantics as S
from recollect.functions import text as T
from recollect.functions import vectors as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_normalizing(spark):
    assert one(spark, T.normalize_text(F.col("a")), a="  He Said: “Yes”，　OK！ ") == "hesaid“yes”ok"
    assert one(spark, T.normalize_answer(F.col("a")), a="The cat, AND a dog.") == "cat dog"
    assert one(spark, T.normalize_answer(F.col("a")), a=None) is None
    assert one(spark, T.number_words(F.col("a")), a="ten of twenty-one often") == "10 of 20-1 often"


def test_contain_and_exact(spark):
    c = lambda o, e: one(spark, T.contains_all(F.col("o"), F.col("e")), o=o, e=e)
    assert c("The answer: Aspirin, 5 mg", ["aspirin", "5mg"]) is True
    assert c("aspirin", []) is False and c("aspirin", ["!!"]) is False and c("", ["aspirin"]) is False
    assert one(spark, T.equals_any(F.col("o"), F.col("e")), o="A-B", e=["x", "ab"]) is True


def test_options(spark):
    letters = lambda a: one(spark, T.option_letters(F.col("a")), a=a)
    assert letters("选A") == ["A"] and letters("答案是：B") == ["B"] and letters("I pick b and D.") == ["B", "D"] and letters("ABLE") == []
    m = lambda o, e: one(spark, T.option_match(F.col("o"), F.col("e")), o=o, e=e)
    assert m("A", ["A. yes"]) and m("nothing", ["no letter"]) and not m("A B", ["A. yes"])


def test_f1_multiset_and_enhanced(spark):
    f = lambda o, e: one(spark, E.token_f1(F.col("o"), F.col("e")), o=o, e=e)
    assert f("big big dog", "big dog") == 2 * 2 / 5 and f("", "dog") == 0.0 and f("cat", "dog") == 0.0
    assert one(spark, E.enhanced_f1(F.col("o"), F.col("e")), o="well it was close to the beach I think yes", e="beach") == 0.5
    assert one(spark, E.multi_hop_f1(F.col("o"), F.col("e")), o="red car, blue bike,", e="blue bike, red car") == 1.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=8))
def test_f1_is_symmetric(a, b):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    x, y = (one(spark, T.f1_of(F.col(p), F.col(q)), a=a, b=b) for p, q in (("a", "b"), ("b", "a")))
    assert x == y and 0 <= x <= 1


def test_judgements(spark):
    assert one(spark, T.says_nothing(F.col("a")), a="This is NOT mentioned anywhere") is True
    s = E.chain_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.col("i"), F.col("q"))
    assert one(spark, s, i=True, q="excellent") == 1.0 and one(spark, s, i=False, q="good") == 0.45 and round(one(spark, s, i=True, q=None), 9) == 0.1
    r = E.evidence_recall(F.col("e"), F.col("c"))
    assert one(spark, r, e=["D1:1", "D2:3"], c=["D1:1"]) == 0.5 and one(spark, r, e=["D1:1"], c=["S1"]) == 1.0 and one(spark, r, e=[], c=["S1"]) == 1.0


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    df = spark.range(1)
    r = df.select(V.norm(a).alias("n"), V.cosine(a, a).alias("c"), V.cosine(a, z).alias("z"), V.cosine(a, F.array(F.lit(1.0))).alias("d"), V.unit(z).alias("u"), V.padded(a, 4).alias("p")).first()
    assert r["n"] == 5 and abs(r["c"] - 1) < 1e-12 and r["z"] is None and r["d"] is None and r["u"] == [0, 0] and r["p"] == [3, 4, 0, 0]


def test_python_functions():
    assert S.lcs("abcde", "ace") == 3 and S.first_object('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}' and S.first_object("no") is None
    assert S.best_window_ratio("abc", "xxabcxx") == 100 and S.best_window_ratio("", "x") == 0
    assert S.exact_meteor(["a", "b"], ["a", "b"]) > 0.9 and S.exact_meteor(["x"], ["a"]) == 0
    assert S.porter_like("running") == "run" and S.porter_like("ponies") == "poni" and S.porter_like("is") == "is"
    assert S.date_parts("on 7 May 2023") == (2023, 5, 7) and S.date_parts("2023-05-07") == (2023, 5, 7) and S.date_parts("maybe")[2] is None
