"""Problem 4: defective answers of question-answer pairs, each with its kind of defect.

The kinds are tried in this order; an answer gets the first that fits:

empty          no list, no element, null, blank, or a filler (fixed list, markup, punctuation alone)
copy           shingle containment in the question finds candidates; the longest common subsequence then covers the
               answer but for a short lead-in or a word, or the question's parts stand in another order
refusal        a sentence aligned with refusal templates of word classes (``refusals.py``)
wrong_language a sentence (not a name, value or unit) whose language, by script and character n-grams (``languages.py``), is
               neither the question's nor one the question asks for
truncated      by the classifier of ``truncation.py``, fitted on these answers

The option letter of multiple choice is no part of an answer. Repeated rows of a key count once. A null question copies
nothing and has no language. Answers of any length are read whole. Empty tables: no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.languages import is_foreign, own_language
from recollect.llm.refusals import is_refusal
from recollect.llm.truncation import truncated
from recollect.llm.words import slices, words
from recollect.runtime import materialize

#: Fillers, without case, punctuation and spacing.
FILLERS = frozenset("null nil nan na tbd tba todo empty blank undefined noanswer notavailable placeholder pending 待补充 待填写 待定 空 暂无 未填写 暂缺".split())
MARKUP = re.compile(r"<[^<>]{0,20}>|&[a-z]{2,6};|&#\d{1,5};", re.I)
LETTER = re.compile(r"^\s*[A-Ha-h]\s*[.:：、)）．]\s*")


def shingles(tokens: list[str], k: int = 3) -> set[tuple[str, ...]]:
    return {(*tokens[i : i + k],) for i in range(len(tokens) - k + 1)}


def common_prefixes(a: list[str], b: list[str]) -> list[int]:
    """Length of the longest common subsequence of b and each of the prefixes of a, by the bit-parallel algorithm."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    state, out = full, [0]
    for w in a:
        hit = state & places.get(w, 0)
        state = (state + hit | state - hit) & full
        out.append(len(b) - state.bit_count())
    return out


def is_filler(answer: str) -> bool:
    rest = "".join(re.findall(r"[^\W_]+", MARKUP.sub(" ", answer).lower()))
    return rest == "" or rest in FILLERS


def is_copy(answer: list[str], own: set, question: list[str], asked: set) -> bool:
    """Whether the words of the answer are the question's but for a lead-in of eight words, three at the end and a few between.

    ``own`` and ``asked`` are the two's shingles. An answer of less than six words copies a question as short as itself.
    """
    if not answer or not question:
        return False
    if len(answer) < 6:
        return common_prefixes(answer, question)[-1] >= max(2, 0.8 * max(len(answer), len(question)))
    contained = len(own & asked) / len(own)
    if contained < 0.6:
        return False
    forward = common_prefixes(answer, question)
    shared = forward[-1]
    if shared >= 0.4 * len(question):
        backward = common_prefixes(answer[::-1], question[::-1])
        tail = len(answer) - forward.index(shared)  # words after the last one that counts
        lead = len(answer) - backward.index(shared)
        if lead <= 8 and tail <= 3 and len(answer) - shared - lead <= max(3, 0.06 * len(answer)):
            return True
    return contained >= 0.9 and len(answer) >= 0.8 * len(question)  # parts in another order


def find(batches):
    """Adds the defect, if it is another than truncation, to (query_id, answer_idx, question, content)."""
    for batch in batches:
        for part, contents in slices(batch, "content"):
            last, asked, cut, spoken = None, [], set(), None
            defects, bodies = [], []
            for question, content in zip(part.column(2).to_pylist(), contents):
                body = LETTER.sub("", content or "", count=1)
                bodies.append(body)
                if is_filler(body):
                    defects.append("empty")
                    continue
                question = question or ""
                if question is not last:
                    last, asked = question, words(question)
                    cut, spoken = shingles(asked), own_language(question)
                tokens = words(body)
                if is_copy(tokens, shingles(tokens), asked, cut):
                    defects.append("copy")
                elif is_refusal(body):
                    defects.append("refusal")
                elif is_foreign(body, question, spoken):
                    defects.append("wrong_language")
                else:
                    defects.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bodies, pa.string()), pa.array(defects, pa.string())], names=["query_id", "answer_idx", "body", "defect"])


def defective(queries: DataFrame) -> DataFrame:
    """(query_id, answer_idx, defect) of the defective answers of ``queries`` (query_id, question, answers)."""
    a = queries.select("query_id", "question", F.posexplode_outer("answers").alias("pos", "answer"))
    a = a.select("query_id", F.coalesce("pos", F.lit(-1)).alias("answer_idx"), "question", F.col("answer.content").alias("content"))
    kind = a.schema["query_id"].dataType.simpleString()
    found = materialize(a.mapInArrow(find, f"query_id {kind}, answer_idx int, body string, defect string"), "answers")
    named = found.where("defect is not null").select("query_id", "answer_idx", "defect")
    cut = truncated(found.where("defect is null"), ["query_id", "answer_idx"], "body", []).where("truncated").select("query_id", "answer_idx", F.lit("truncated").alias("defect"))
    order = F.when(F.col("defect") == "truncated", 1).otherwise(0)
    return named.union(cut).groupBy("query_id", "answer_idx").agg(F.min_by("defect", F.struct(order, "defect")).alias("defect"))
