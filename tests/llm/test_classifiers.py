import random

from pyspark.sql import functions as F

from recollect.llm import defects
from recollect.llm.reading import reading_levels
from recollect.llm.totals import estimate
from recollect.llm.truncation import holdout, limits, source_key, truncated

NAMES = "Miller Jones Carter Reed Brook".split()


def sentence(rng):
    return f"{rng.choice(['The patient', 'Dr ' + rng.choice(NAMES), 'A neighbour'])} {rng.choice(['noticed', 'reported', 'mentioned'])} {rng.choice(['mild', 'sharp', 'steady'])} {rng.choice(['headaches', 'back pain', 'nausea'])} after {rng.choice(['walking', 'dinner', 'work', 'the flight'])}."


def test_truncation_held_out(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1500):
        t = " ".join(sentence(rng) for _ in range(rng.randint(1, 4)))
        fate = k % 10
        if fate == 0:
            rows.append((k, "short-field", t[:90], len(t) > 90 and not t[:90].rstrip().endswith(".")))
        elif fate == 1:
            cut = rng.randint(20, len(t) - 4)
            rows.append((k, "other", t[:cut], not t[:cut].rstrip().endswith(".")))
        elif fate == 2:
            rows.append((k, "other", rng.choice(["ok thanks", "will do", "not yet"]), False))
        else:
            rows.append((k, "other", t, False))
    df = spark.createDataFrame(rows, "k long, source string, text string, truth boolean")
    out = {r["k"]: r["truncated"] for r in truncated(df, ["k"], "text", ["source"]).collect()}
    hit = sum(out[k] for k, _, _, y in rows if y) / sum(y for *_, y in rows)
    false = sum(out[k] for k, _, _, y in rows if not y) / sum(not y for *_, y in rows)
    assert hit > 0.9 and false < 0.05


def test_truncation_edge_cases(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "...", "a"), (4, "Whole.", None), (4, "Whole.", None)], "k long, text string, source string")
    assert [r["k"] for r in truncated(df, ["k"], "text", ["source"]).collect()] == [4]
    assert truncated(df.where("k < 0"), ["k"], "text", ["source"]).count() == 0


def test_cuts_far_behind_the_beginning_are_learnt_and_held_out(spark):
    """Texts whose ends differ from their beginnings, all longer than 2,000 characters."""
    rng = random.Random(9)
    rows = []
    for k in range(300):
        head = " ".join(sentence(rng) for _ in range(50))
        tail = " ".join(f"Blorrent {rng.choice(['vatic', 'quoril', 'menth'])} strell ondor {rng.choice(['plim', 'gracht'])}." for _ in range(3))
        t = head + " " + tail
        rows.append((k, t[: -rng.randint(4, 60)].rstrip() + "x" if k % 20 == 0 else t, k % 20 == 0))
    df = spark.createDataFrame(rows, "k long, text string, truth boolean")
    out = {r["k"]: r["truncated"] for r in truncated(df, ["k"], "text", []).collect()}
    assert sum(out[k] for k, _, y in rows if y) >= 13 and sum(out[k] for k, _, y in rows if not y) <= 5
    r = holdout(df, ["k"], "text", []).collect()[0]
    assert r["recall"] > 0.9 and r["cuts"] > 50


def test_truncation_without_examples_rests_on_the_limit(spark):
    rows = [(k, "abcdefghij klmno pqrst") for k in range(8)] + [(20, "Short.")]
    out = {r["k"]: r["truncated"] for r in truncated(spark.createDataFrame(rows, "k long, text string").selectExpr("k", "'s' as source", "text"), ["k"], "text", ["source"]).collect()}
    assert out == {**{k: True for k in range(8)}, 20: False}


def test_limits_and_source_spelling(spark):
    rows = [("x", 100)] * 30 + [("x", n) for n in range(60, 100, 4)] + [("y", n) for n in range(60, 200)]
    out = limits(spark.createDataFrame(rows, "source string, len int"), ["source"]).collect()
    assert [(r["source"], r["field_limit"]) for r in out] == [("x", 100)]
    df = spark.createDataFrame([("App Chat",), (" app_chat",), ("APP-CHAT",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(source_key(F.col("s"))).collect()] == ["appchat", "appchat", "appchat", None, None]


def test_defect_kinds():
    q = "Which medicine did Dr Reed recommend against mild headaches after the long flight to Denver?"
    asked = defects.words(q)
    cut = defects.shingles(asked)
    copy = lambda a: defects.is_copy(defects.words(a), defects.shingles(defects.words(a)), asked, cut)
    assert copy(q) and copy("You asked: " + q.lower()) and not copy(q + " Dr Reed recommended twenty milligrams of aspirin daily.") and not copy("Dr Reed recommended aspirin.")
    fits = defects.is_refusal
    assert fits("Hello. I cannot answer questions about high blood pressure.") and fits("抱歉，我无法回答这个问题。") and fits("此事还是留给翟霖岑医生来说吧，我不便多言。")
    assert not fits("The patient declined to answer.") and not fits("Sorry for the late note: the dose was 5 mg of aspirin.") and not fits("患者拒绝注射该药。")
    for a in ("", "  ", "N/A", "<br/>", "待补充", "...", "[]"):
        assert defects.is_filler(a)
    assert not defects.is_filler("No") and not defects.is_filler("否")
    foreign = lambda a, question: defects.is_foreign(a, question, defects.own_language(question))
    assert foreign("El médico aconsejó menos sal y más ejercicio.", q) and not foreign("El médico aconsejó menos sal y más ejercicio.", q + " Answer in Spanish.")
    assert not foreign("40 mg", "他今天吃了什么药？") and foreign("He took the tablets at noon with water.", "他今天吃了什么药？")
    for other in ("Она принимала таблетки утром после завтрака.", "그녀는 아침 식사 후에 약을 먹었습니다.", "彼女は朝食の後に薬を飲みました。", "Pani miała ból po każdej podróży.", "La dose est passée à 20 unités et elle va mieux.", "De pijn was na elke reis weer minder."):
        assert foreign(other, q), other
    assert not any(foreign(a, q) for a in ("Zupum care home", "Metformin and losartan", "about 11 weeks after exam week", "Mr Tougiox noted nosebleeds plus weight loss."))


def test_refusals_in_wordings_of_no_list():
    held_out = """I cannot share that information with you.
    I'm afraid I cannot assist with this.
    We are not permitted to talk about a patient's file.
    That is not a subject I will go into.
    My instructions forbid me to speak about this.
    I have no authority to release such records.
    Regrettably, this falls outside my remit.
    I would rather not say.
    抱歉,我不能透露这些内容。
    对不起，这方面的内容我不方便透露。
    不好意思，恕不能告知。
    这类问题我无可奉告。"""
    for a in held_out.splitlines():
        assert defects.is_refusal(a.strip()), a
        assert defects.is_refusal(a.strip() + " The clinic opens at nine on weekdays and the pharmacy next door sells aspirin." * 20), a
    for a in ("She said she could not discuss it with her son.", "He refused to share the record with the clinic.", "The record doesn't mention it.", "I did not find it in the notes.", "她说不便透露。", "记录里没有提到。", "医生没有回答他的问题。"):
        assert not defects.is_refusal(a), a


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_bit_parallel_lcs_equals_the_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert defects.common_prefixes(a, b) == [lcs(a[:k], b) for k in range(len(a) + 1)]


def test_copies_with_a_word_changed_or_parts_reordered():
    q = "Dr Reed recommended less salt against mild headaches, and the long flight to Denver made the patient tired. Which medicine did the nurse bring in the evening?"
    asked = defects.words(q)
    copy = lambda a: defects.is_copy(defects.words(a), defects.shingles(defects.words(a)), asked, defects.shingles(asked))
    assert copy(q.replace("salt", "sugar")) and copy("Which medicine did the nurse bring in the evening? Dr Reed recommended less salt against mild headaches, and the long flight to Denver made the patient tired.")
    assert not copy("The nurse brought aspirin in the evening.") and not copy("mild headaches, and the long flight")
    short = defects.words("What is it?")
    assert defects.is_copy(short, set(), short, set()) and not defects.is_copy(defects.words("It is"), set(), short, set())


def test_defective_rows(spark):
    a = "array<struct<content:string,is_correct:boolean,explanation:string>>"
    rows = [("q1", "What is it?", None), ("q2", "What is it?", []), ("q3", "What is it?", [(None, True, None), ("A. It is the red one.", False, None)]), ("q3", "What is it?", [(None, True, None), ("A. It is the red one.", False, None)]), ("q4", None, [("I must decline to answer this.", True, "")])]
    out = {(r["query_id"], r["answer_idx"]): r["defect"] for r in defects.defective(spark.createDataFrame(rows, f"query_id string, question string, answers {a}")).collect()}
    assert out == {("q1", -1): "empty", ("q2", -1): "empty", ("q3", 0): "empty", ("q4", 0): "refusal"}
    assert defects.defective(spark.createDataFrame([], f"query_id string, question string, answers {a}")).count() == 0


def test_reading_levels(spark):
    rng = random.Random(8)
    pools = {"plain": "mum dad dog sit eat jam cat bed hot", "general": "tablet nurse clinic weekly pressure sample", "advanced": "framework analysis whereas correlation findings", "specialist": "thrombolysis troponin nephropathy titrated hazard"}
    common = "the of and with a in".split()
    docs, ratings = [], []
    for k in range(240):
        level = [*pools][k % 4]
        docs.append((k, " ".join(rng.choice(pools[level].split() + common) for _ in range(90)), level))
        if k < 160:
            ratings.append((k, "r1", rng.choice([*pools]) if rng.random() < 0.05 else level.upper() + " "))
    ratings += [(0, "r2", None), (None, "r1", "plain"), (1, "r2", "nonsense")]
    df = spark.createDataFrame([*docs, (900, None, ""), (901, "", ""), (902, "short text", "")], "doc_id long, text string, level string")
    r = spark.createDataFrame(ratings, "doc_id long, rater string, reading_level string")
    out = {x["doc_id"]: x["level"] for x in reading_levels(df, r).collect()}
    assert set(out) == {d[0] for d in docs if len(d[1]) >= 250}
    held = [d for d in docs[160:] if d[0] in out]
    assert sum(out[d[0]] == d[2] for d in held) > 0.95 * len(held)
    assert reading_levels(df, r.where("doc_id < 0")).count() == 0
    assert reading_levels(df.where("doc_id < 0"), r).count() == 0


def test_token_totals(spark):
    from recollect.llm.queries import TOKENIZERS

    rng = random.Random(6)
    m = "array<struct<turn:int,role:string,content:string,agent_type:string>>"
    rows = [(k, k % 3 if k % 7 else None, "App Chat" if k % 2 else "app_chat", ["en", "EN-us", None][k % 3], [(1, "user", " ".join(sentence(rng) for _ in range(rng.randint(1, 9))), ""), (2, "assistant", None, "")]) for k in range(300)]
    rows += [rows[0], (900, 1, None, "zh", None), (901, 1, "x", None, [])]
    s = spark.createDataFrame(rows, f"session_id long, persona_id long, source string, lang string, messages {m}")
    p = spark.createDataFrame([(0, "Acute"), (1, "rehab"), (2, None)], "id long, category string")
    totals, held = estimate(s, p, f"{TOKENIZERS}/byte_bpe_50k.json")
    t = totals.collect()
    assert sum(r["sessions"] for r in t) == 302
    assert {r["category"] for r in t} == {"acute", "rehabilitation", "unknown"}
    assert all(abs(r["error"]) < 0.05 for r in held.collect())
    assert estimate(s.where("session_id < 0"), p, f"{TOKENIZERS}/byte_bpe_50k.json")[0].count() == 0
