import numpy as np

from recollect.llm import neardup
from tests.llm.test_neardup import SCHEMA, brute


def test_pairs_beside_the_centre_of_a_bucket(spark, monkeypatch):
    """One bucket holds all. The centre h matches x alone; y matches x, and u and v match each other only."""
    monkeypatch.setattr(neardup, "band_keys", lambda tokens, counts, common: np.zeros((len(counts), 1), np.uint64))
    a, b = [f"a{k}" for k in range(10)], ["b0", "b1", "b2"]
    texts = {"h": a, "x": a[:9] + b[:1], "y": a[:7] + b, "u": [f"u{k}" for k in range(10)], "v": [f"u{k}" for k in range(9)]}
    rows = [("t", f"{i}-{k}", " ".join(w)) for i, (k, w) in enumerate(texts.items())]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    found = {tuple(r) for r in neardup.pairs(members, links).collect()}
    assert found == brute(rows) == {("t", "0-h", "1-x"), ("t", "1-x", "2-y"), ("t", "3-u", "4-v")}


def test_a_bucket_with_many_failing_members_is_split(spark, monkeypatch):
    """All texts in one bucket, of which only one member beside the centre's near-duplicates may be compared with all."""
    from tests.llm.test_neardup import corpus

    monkeypatch.setattr(neardup, "band_keys", lambda tokens, counts, common: np.zeros((len(counts), 1), np.uint64))
    monkeypatch.setattr(neardup, "FAILING", 1)
    rows = [r for r in corpus(20) if r[0] == "a"]
    found = {tuple(r) for r in neardup.pairs(*neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert found == brute(rows)


def test_stars_link_a_large_group_in_proportion_to_its_size(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [("t", f"{k:03d}", " ".join([*base, f"x{k}"])) for k in range(120)]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), closed=False)
    assert links.count() <= neardup.BINS * 120
    assert {tuple(r) for r in neardup.groups(members, links, counted=False).select("group_id", "copies").distinct().collect()} == {("000", 1)}
