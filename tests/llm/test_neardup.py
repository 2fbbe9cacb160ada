import random
from collections import Counter

from recollect.llm.neardup import groups, near_duplicates, pairs
from recollect.llm.words import words

SCHEMA = "tbl string, id string, text string"


def brute(rows, threshold=0.8):
    out = set()
    bags = [(t, i, Counter(words(x))) for t, i, x in rows if x and words(x)]
    for k, (t, i, a) in enumerate(bags):
        for u, j, b in bags[k + 1 :]:
            if t == u and i != j and sum((a & b).values()) >= threshold * max(sum(a.values()), sum(b.values())):
                out.add((t, *sorted((i, j))))
    return out


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + list("早晚饭前后吃药量血压医院检验糖尿病头痛")
    rows = []
    for k in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 45))]
        rows.append(("a", f"r{k:04d}", " ".join(base)))
        for c in range(rng.randint(0, 3)):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(copy) // 6))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rng.shuffle(copy)
            rows.append((rng.choice("aab"), f"r{k:04d}c{c}", " ".join(copy).upper() + "."))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    members, links = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    found = {tuple(r) for r in pairs(members, links).collect()}
    expected = brute(rows)
    assert len(found & expected) >= 0.98 * len(expected)
    assert found <= expected


def test_copies_nulls_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("a", f"k{k}", text) for k in range(5)] + [("a", "k0", text), ("a", "n", None), ("a", "e", ""), ("a", "p", " ?! "), ("b", "x", text)]
    members, links = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert pairs(members, links).count() == 10
    g = {r["id"]: r for r in groups(members, links).collect() if r["tbl"] == "a"}
    assert len(g) == 5 and {r["group_id"] for r in g.values()} == {"k0"} and {r["n_links"] for r in g.values()} == {4}


def test_chain_is_one_group(spark):
    base = [f"t{k}" for k in range(20)]
    rows = [("a", f"c{k}", " ".join(base[: 20 - 2 * k] + [f"new{j}" for j in range(2 * k)])) for k in range(5)]
    members, links = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in pairs(members, links).collect()} == brute(rows)
    assert groups(members, links).select("group_id").distinct().count() == 1


def test_empty_table(spark):
    members, links = near_duplicates(spark.createDataFrame([], SCHEMA))
    assert pairs(members, links).count() == 0
    assert groups(members, links).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a", "1", "x y z u v w", 1, "n"), ("a", "2", "X Y z u v w", 2, "m")], SCHEMA + ", n int, cls string")
    assert [tuple(r) for r in pairs(*near_duplicates(df)).collect()] == [("a", "1", "2")]
