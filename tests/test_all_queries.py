"""Searches over all queries, not over those whose id is divisible by 50: every query that shares a word with a document is answered."""

import duckdb
import numpy as np
import pytest

from recollect.operators import retrieval as R
from recollect.operators import scoring
from recollect.plans.catalog import QUERIES, SQL

WORDS = "knee pain sleep back tea walk rain fish salt milk".split()


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "_INDEXES", {})
    docs = [(d, " ".join(WORDS[(d * s) % 10] for s in range(1, 3 + d % 5))) for d in range(30)] + [(30, None)]
    # ids around multiples of 50, one without a text, one that stands on two rows; clues before the last sentence
    queries = [(f"q{q:010}", f"{WORDS[q % 10]} and {WORDS[(q + 3) % 10]} with {WORDS[(q + 5) % 10]}. Why {WORDS[(q + 7) % 10]}?") for q in [*range(1, 12), 49, 50, 51, 100]]
    queries += [("q0000000060", None), queries[4]]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(queries, "query_id string, question string").coalesce(1).write.parquet(f"{tmp_path}/queries.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["C11_context_packing", "R1_bm25", "T1_bm25_topk", "Q20_corpus_order"])
def test_every_query_is_answered(spark, folder, name):
    duck = duckdb.connect()
    for t in ("documents", "queries"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
    got = plain(map(tuple, df.collect()))
    assert {r[0] for r in got} == {*range(1, 12), 49, 50, 51, 100}
    assert got == plain(want)


def test_a_block_of_queries_holds_its_terms_alone():
    """Of many blocks at once in a task none keeps a matrix of queries and terms, which is made for the documents at hand."""
    rng = np.random.default_rng(1)
    w = rng.random((2048, 300)) * (rng.random((2048, 300)) < 0.2)
    rows, codes = np.nonzero(w)
    x = scoring.Chunk(0, 2048, rows, codes, w[rows, codes], 300)
    assert sum(v.nbytes for v in vars(x).values() if isinstance(v, np.ndarray)) < 2 * (rows.nbytes + codes.nbytes + w[rows, codes].nbytes)
    docs = rng.random((40, 300)) * (rng.random((40, 300)) < 0.2)
    [(lo, s)] = x.scores(40, *np.nonzero(docs), docs[docs > 0])
    assert lo == 0 and np.allclose(s, w @ docs.T)
