import random

import pytest

from recollect.llm.encoding import Bpe, encode_documents
from recollect.llm.queries import TOKENIZERS

tokenizers = pytest.importorskip("tokenizers")
PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def samples():
    rng = random.Random(5)
    alphabet = "abcdefghij the ing ation 的一是日本語覚醒 \t\n\n  éüñ0123456789²½'s't'll<|endoftext|>.,!😀​﻿　\x1c"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(400)] + ["<|endoftext|>", " ", "a" * 3000, "早" * 500, "Antidisestablishmentarianism " * 20]


def test_equals_reference(spark, reference):
    rows = [(k, t) for k, t in enumerate(samples())]
    out = {r["doc_id"]: list(r["ids"]) for r in encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert out == {k: reference(t) for k, t in rows}


def test_null_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (3, "hi", "x"), (None, "hi", "x")], "doc_id long, text string, ids string")
    out = encode_documents(df, PATH).collect()
    assert len(out) == 5 and [list(r["ids"]) for r in out if r["doc_id"] in (1, 2)] == [[], []]
    assert encode_documents(df.where("doc_id < 0"), PATH).count() == 0


def test_exact_merging_agrees_with_speculation(reference):
    bpe = Bpe(*Bpe.parts(PATH))
    for word in ["hello", " tokenization", "日本語", "naïve", "0000", "''''"]:
        assert [int(bpe.ids[t]) for t in bpe.exact(word.encode())] == [int(bpe.ids[t]) for t in bpe.encode_words([word])[0]] == reference(word)
