"""Searches by block products: against brute force, with ties and small blocks, and without a row per query and document."""

import os
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import retrieval as R
from recollect.operators import scoring
from recollect.plans.catalog import QUERIES

DATA = os.environ.get("RECOLLECT_TEST_DATA", "/root/testdata/sf0.001")


def brute(queries, docs, k):
    """BM25 by loops; ``docs``: (doc_id, text), where an id may have several rows."""
    import math
    from collections import Counter, defaultdict

    words = [(d, t.split()) for d, t in docs]
    n, avg = len(docs), sum(len(w) for _, w in words) / len(docs)
    post = defaultdict(Counter)  # term -> (doc, length) -> tf
    for d, w in words:
        for t in w:
            post[t][d, len(w)] += 1
    raw = {t: math.log((n - len(p) + 0.5) / (len(p) + 0.5)) for t, p in post.items()}
    mean = sum(raw.values()) / len(raw)
    out = []
    for q, text in queries:
        s = defaultdict(float)
        for t in text.split():
            for (d, dl), tf in post.get(t, {}).items():
                s[d] += (0.25 * mean if raw[t] < 0 else raw[t]) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
        best = sorted((-round(x, 7), d) for d, x in s.items() if x > 1e-9)[:k]
        out += [(q, d, -x) for x, d in best]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_best_by_blocks_equals_brute_force(spark, monkeypatch, small):
    """Repeated texts tie; ids stand on several rows, some of the same length."""
    if small:
        for name, value in (("QUERIES", 7), ("DOCS", 5), ("MOST_TERMS", 60)):
            monkeypatch.setattr(scoring, name, value)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(vocabulary, [40 / (i + 1) for i in range(40)], k=n))
    docs = [(d, text(rng.randint(1, 12))) for d in range(60)]
    docs += [(d + 100, t) for d, t in docs[:25]] + [(d, text(6)) for d in range(10)] + [(d, text(len(docs[d][1].split()))) for d in range(5)]
    queries = [(q, text(4)) for q in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = R.bm25(spark.createDataFrame(queries, "query_id long, text string"), df, T.mixed_tokens, 4)
    assert sorted((r["query_id"], r["doc_id"], round(r["score"], 7)) for r in got.collect()) == brute(queries, docs, 4)


# each of these once joined all postings with the queries' words, a row for every pair that shares one
@pytest.mark.parametrize("name", ["R1_bm25", "C11_context_packing", "Q20_corpus_order", "R4_unique_terms", "T1_bm25_topk", "Q4_hybrid_recall", "R21_relation_search"])
def test_no_search_reads_the_postings_of_all_documents(spark, monkeypatch, name):
    of = R.Index.postings
    monkeypatch.setattr(R, "_INDEXES", {})
    monkeypatch.setattr(R.Index, "postings", lambda self, docs=None: of(self, docs) if docs is not None else pytest.fail("postings of all documents"))
    assert QUERIES[name](spark, DATA).count()


def test_full_text_joins_no_words(spark):
    plan = QUERIES["R8_full_text"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_word_search_writes_no_row_per_query_and_document(spark, monkeypatch):
    """Both modes against loops, by small blocks; a word begins others, and the heaviest field counts."""
    written, write = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: written.append(name) or write(df, name))
    for name, value in (("QUERIES", 3), ("DOCS", 4)):
        monkeypatch.setattr(scoring, name, value)
    rng = random.Random(5)
    vocabulary = ["sleep", "sleepy", "slept", "sle", "pain", "painful", "pa", "knee", "back"]
    fields = [(f"d{i:02}", " ".join(rng.sample(vocabulary, rng.randint(1, 3))), w) for i in range(25) for w in (1.0, 0.4)]
    queries = [(q, " ".join(rng.sample(vocabulary, rng.randint(1, 3)))) for q in range(12)]
    expected = []
    for q, text in queries:
        s, found = {}, {}
        for d in sorted({d for d, *_ in fields}):
            own = [max([w for x, t, w in fields if x == d and any(v == word or len(word) >= 3 and v.startswith(word) for v in t.split())], default=0) for word in text.split()]
            if any(own):
                s[d], found[d] = round(sum(own) / (sum(own) + 1), 6), all(own)
        whole = sum(found.values()) >= 4
        best = sorted((-x, d) for d, x in s.items() if found[d] or not whole)[:4]
        expected += [(q, d, -x, "and" if whole else "or") for x, d in best]
    got = R.word_search(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(fields, "doc_id string, text string, weight double"), T.mixed_tokens, 4)
    assert sorted((r["query_id"], r["doc_id"], round(r["score"], 6), r["mode"]) for r in got.collect()) == sorted(expected)
    assert {m for *_, m in expected} == {"and", "or"} and "hits" not in written


def test_word_search_scores_a_set_of_words_once(spark, monkeypatch):
    """Queries that ask for the same words, in any order, share one search, and its one pass serves both modes."""
    seen, best = [], R.best_by_terms
    monkeypatch.setattr(R, "best_by_terms", lambda terms, *a, **k: seen.append(terms.select("query_id").distinct().count()) or best(terms, *a, **k))
    fields = spark.createDataFrame([(f"d{i}", "knee pain" if i < 3 else "back pain", 1.0) for i in range(6)], "doc_id string, text string, weight double")
    queries = spark.createDataFrame([(q, "pain knee" if q % 2 else "knee pain") for q in range(20)] + [(20, "back knee")], "query_id long, text string")
    got = {}
    for r in R.word_search(queries, fields, T.mixed_tokens, 3).collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["mode"], round(r["score"], 6)))
    assert seen == [2]
    assert all(sorted(got[q]) == [(f"d{i}", "and", 0.666667) for i in range(3)] for q in range(20))
    assert sorted(got[20]) == [(f"d{i}", "or", 0.5) for i in range(3)]


@pytest.mark.parametrize("name", ["Q1_rank_fusion", "R3_hybrid"])
def test_no_fusion_reads_the_postings_of_all_documents(spark, monkeypatch, name):
    monkeypatch.setattr(R, "_INDEXES", {})
    monkeypatch.setattr(R.Index, "postings", lambda *_: pytest.fail("postings of all documents"))
    assert QUERIES[name](spark, DATA).count()
