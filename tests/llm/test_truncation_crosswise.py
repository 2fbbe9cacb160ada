import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_truncation_whole import rows_of

from recollect.llm import truncation
from recollect.llm.fitting import logistic_fit
from recollect.llm.words import HAN


@pytest.mark.parametrize("part", [200, 600, 12_000])
def test_threshold_rests_on_the_cuts_of_all_texts(spark, part):
    """With eight parts, three and one."""
    t = truncation.prepared(spark.createDataFrame(rows_of(1600), "k long, text string, truth boolean").repartition(3), ["k"], "text", [])
    *_, threshold, held = truncation.fitted(t, ["k"], [], part)
    made = truncation.examples(t.selectExpr("xxhash64(k, _text) as h", "_text").toArrow().to_batches(), [], truncation.Lexicon(np.zeros(0, np.int64), np.zeros(0, np.int8)), {})
    cuts = sum(np.count_nonzero(b.column(1)) for b in made)
    odds = np.array([r["odds"] for r in held.where("cut").collect()])
    assert cuts > 2500 and len(odds) == cuts  # a fifth of the texts has about 600
    assert threshold == pytest.approx(min(truncation.HIGHEST, np.quantile(np.round(odds, 3), truncation.LOSS)))


def test_a_text_takes_no_part_in_the_fit_that_scores_it():
    """Features by chance: each set is found again by its own fit, and told by no other."""
    rng = np.random.default_rng(3)
    h, y = np.repeat(np.arange(400), 2), rng.integers(0, 2, 800).astype(float)
    r, c = np.repeat(np.arange(800), 30), rng.integers(0, 60, 24_000)
    fits = dict(truncation.fit_part(h, r, c, y, truncation.FOLDS))
    right = lambda w, keep: ((truncation.logistic_scores(r, c, 800, w) > 0) == (y > 0))[keep].mean()
    assert right(fits[-1], h >= 0) > 0.58 and np.mean([right(fits[f], h % 5 == f) for f in range(5)]) < 0.55


def test_features_are_packed_and_read_again():
    count, columns = np.array([2, 0, 3]), np.array([0, truncation.WIDTH - 1, 70_000, 5, 255])
    r, c = truncation.unpacked(truncation.packed(columns, count).slice(1))
    assert r.tolist() == [1, 1, 1] and c.tolist() == [70_000, 5, 255]
    assert [len(x) for x in truncation.unpacked(pa.array([], pa.binary()))] == [0, 0]


def test_a_feature_given_as_numbers_is_fitted_like_repeated_columns():
    rng = np.random.default_rng(0)
    rows = np.repeat(np.arange(600), rng.integers(1, 9, 600))
    columns, y, weight = rng.integers(0, 50, len(rows)), (rng.random(600) < 0.4).astype(float), rng.random(600)
    own = columns < 40
    one = logistic_fit(rows, np.minimum(columns, 40), y, 41, weight)[:40]
    assert np.allclose(one, logistic_fit(rows[own], columns[own], y, 40, weight, also=np.bincount(rows[~own], minlength=600)))


def test_lexicon_counts_like_a_loop():
    rng = random.Random(6)
    piece = re.compile(rf"[{HAN}]|[^\W\d_{HAN}]+|\d+|[^\w\s]|_")
    texts = ["".join(rng.choice(["ab", "Zé", "药", "片", "1", "२", " ", ",", "。", "_", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    seen, stops = Counter(), Counter()
    for t in texts:
        parts = piece.findall(t.lower())
        for a, b, after in zip(["", *parts], parts, parts[1:]):
            word = a + b if a and re.match(f"[{HAN}]{{2}}", a + b) else b
            if word[0].isalpha():
                seen[truncation.word_hash(word)] += 1
                stops[truncation.word_hash(word)] += not after[0].isalnum()
    out = [r for b in truncation.lexicon([pa.record_batch({"_text": texts})]) for r in b.to_pylist()]
    assert {r["word"]: r["seen"] for r in out} == seen and {r["word"]: r["stops"] for r in out} == stops
