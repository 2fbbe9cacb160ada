import random

from recollect.llm.leakage import leaks

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def prose(rng, n, pool="w"):
    return " ".join(f"{pool}{rng.randrange(4000)}" for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(2)
    head = "Read the note and answer. "
    items = [(k, (head if k % 2 else "") + prose(rng, 60) + ".") for k in range(40)]
    docs, expected = [], set()
    for k, text in items:
        words = text.replace(head, "").split()
        fill = lambda n: prose(rng, n, "z")
        edited = [w if i % 9 else "changed" for i, w in enumerate(words)]
        cases = {
            0: fill(30) + " " + " ".join(words).upper().replace(".", "") + " " + fill(30), 1: fill(20) + "\n" + " ".join(words[10:40]), 2: " ".join(edited) + fill(10),
            3: " ".join(words[:30]) + " " + fill(25) + " " + " ".join(words[30:]),
        }
        for c, t in cases.items():
            docs.append((k * 10 + c, t))
            expected.add((k * 10 + c, k))
        docs.append((k * 10 + 7, fill(40) + " " + " ".join(words[5:13]) + " " + fill(40)))  # a few words
        docs.append((k * 10 + 8, head + fill(60)))  # the instruction alone
    out = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert out == expected


def test_chinese_and_case(spark):
    item = "患者早饭前少吃酸白菜，却能接受燕麦粥；八月十七日报出血清肌酐为九毫克。谁把血压计带给了翟霖岑？"
    docs = [(1, "前言。" + item[:30] + "后话。"), (2, "患者早饭前少吃面条。")]
    out = leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(9, item)], ITEM)).collect()
    assert [(r["doc_id"], r["item_id"]) for r in out] == [(1, 9)]


def test_nulls_empty_and_repeated(spark):
    item = "a b c d e f g h i j k l m n o p"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, item, 0), (3, item, 0)], DOC + ", item_id long")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a b")], ITEM)
    assert [(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()] == [(3, 1)]
    assert leaks(docs.where("doc_id < 0"), items).count() == 0
    assert leaks(docs, items.where("item_id < 0")).count() == 0


def test_blocks_of_the_held_out_side_change_nothing(spark, monkeypatch):
    """Passages that are half common phrases: which words are telling is counted over all of them, whatever the blocks."""
    from recollect.llm import leakage

    rng = random.Random(5)
    common = prose(rng, 30, "c")
    items = [(k, common + " " + prose(rng, 30)) for k in range(40)]
    docs = [(k, prose(rng, 20, "z") + " " + (t if k % 2 else common)) for k, t in items]
    found = []
    for most in (leakage.MOST_SEEDS, 1500):
        monkeypatch.setattr(leakage, "MOST_SEEDS", most)
        found.append({(r["doc_id"], r["item_id"], round(r["told"], 9)) for r in leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()})
    assert found[0] == found[1] and {(d, i) for d, i, _ in found[0]} == {(k, k) for k in range(1, 40, 2)}


def test_a_third_of_a_short_passage(spark):
    words = "the nurse brought aspirin tablets before lunch on friday but nobody had asked her to".split()
    docs = [(1, "filler words here " + " ".join(words[2:7]) + " and other words")]
    out = leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(5, " ".join(words))], ITEM)).collect()
    assert [(r["doc_id"], r["item_id"], r["covered"]) for r in out] == [(1, 5, 5)]


def test_one_interruption_of_any_length(spark):
    rng = random.Random(6)
    words = prose(rng, 40).split()
    docs = [(1, " ".join(words[:8]) + " " + prose(rng, 400, "z") + " " + " ".join(words[8:16]))]
    assert leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(5, " ".join(words))], ITEM)).count() == 1
