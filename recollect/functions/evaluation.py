"""Answer metrics built from ``text``: each takes columns and returns a score or a verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import text as T

#: Factors of a judge's verdict on the quality of a reasoning chain, and the one for other verdicts.
QUALITY = {"excellent": 1.0, "good": 0.9, "partial": 0.7, "poor": 0.4, "none": 0.1}
OTHER_QUALITY = 0.5


def token_f1(output: Column, expected: Column) -> Column:
    return T.f1_of(T.answer_tokens(output), T.answer_tokens(expected))


def multi_hop_f1(output: Column, expected: Column) -> Column:
    """Mean over the expected parts (at commas) of the best F1 with any part of the answer; a text without parts is one."""

    def parts(c: Column) -> Column:
        p = F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: s != "")
        return F.transform(F.when(F.size(p) > 0, p).otherwise(F.array(c)), T.answer_tokens)

    # parts are normalized before they are compared, and the sum and the number come from one pass over the best scores
    best = F.transform(parts(expected), lambda g: F.array_max(F.transform(parts(output), lambda p: T.f1_of(p, g))))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(best, zero, lambda a, v: F.struct((a.s + v).alias("s"), (a.n + 1).alias("n")), lambda a: a.s / a.n)


def says(output: Column, expected: Column) -> Column:
    """Whether an answer contains the expected text: as it is, normalized, by yes or no, or with digits for number words."""
    o, e = F.lower(F.trim(output)), F.lower(F.trim(expected))
    polar = F.lit(False)
    for p in ("yes", "no"):
        polar = polar | (e.isin(p, f"likely {p}") & (F.startswith(o, F.lit(p)) | F.startswith(o, F.lit(f"likely {p}"))))
    return F.contains(o, e) | F.contains(T.normalize_answer(output), T.normalize_answer(expected)) | polar | F.contains(T.number_words(o), T.number_words(e))


def enhanced_f1(output: Column, expected: Column) -> Column:
    f1 = token_f1(output, expected)
    return F.when(f1 >= 0.5, f1).when(says(output, expected), F.greatest(f1, F.lit(0.5))).otherwise(f1)


def chain_score(nodes: Column, causal: Column, coherence: Column, informed: Column, quality: Column) -> Column:
    """Weighted judge scores of a reasoning chain; halved without patient information, scaled by the verdict."""
    base = 0.35 * nodes + 0.35 * causal + 0.30 * coherence
    q = F.coalesce(quality, F.lit("none"))
    factor = F.lit(OTHER_QUALITY)
    for name, value in QUALITY.items():
        factor = F.when(q == name, value).otherwise(factor)
    return base * F.when(informed, 1.0).otherwise(0.5) * factor


def evidence_recall(evidence: Column, context: Column) -> Column:
    """Share of evidence ids among the context's ids; ids of whole sessions (S..) are compared by session. 1 if either is missing."""
    by_session = F.exists(context, lambda c: F.startswith(c, F.lit("S")))
    wanted = F.when(by_session, F.transform(evidence, lambda e: F.concat(F.lit("S"), F.regexp_extract(e, r"^D(\d+)", 1)))).otherwise(evidence)
    found = F.size(F.filter(wanted, lambda e: F.array_contains(context, e)))
    missing = evidence.isNull() | context.isNull() | (F.size(evidence) == 0) | (F.size(context) == 0)
    return F.when(missing, F.lit(1.0)).otherwise(F.try_divide(found.cast("double"), F.size(evidence)))


def bleu(output: Column, expected: Column, order: int, epsilon: float = 0.1) -> Column:
    """Geometric mean of clipped n-gram precisions (``epsilon`` for no match) with the brevity penalty, over token arrays."""
    logs = F.lit(0.0)
    for n in range(1, order + 1):
        a, b = T.ngrams(output, n), T.ngrams(expected, n)
        same = T.multiset_overlap(a, b)
        total = F.greatest(F.size(a), F.lit(1))
        logs = logs + F.log(F.when(same > 0, same.cast("double")).otherwise(epsilon) / total) / order
    brevity = F.when(F.size(output) > F.size(expected), 1.0).otherwise(F.exp(1 - F.size(expected) / F.greatest(F.size(output), F.lit(1))))
    return F.when((F.size(output) > 0) & (T.multiset_overlap(output, expected) > 0), brevity * F.exp(logs)).otherwise(0.0)


def parts_of(c: Column) -> Column:
    """The parts of a text at commas, without blanks; a text without parts is one."""
    p = F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(p) > 0, p).otherwise(F.array(c))


def category_f1(output: Column, expected: Column, multi_hop: Column, open_domain: Column) -> Column:
    """F1 by category: several hops part by part, open questions against what stands before a semicolon; 0 without an expected answer.

    A score under 0.5 is lifted to it where the answer says what is expected.
    """
    gold = F.when(open_domain, F.trim(F.split_part(expected, F.lit(";"), F.lit(1)))).otherwise(expected)
    f = F.when(multi_hop, multi_hop_f1(output, gold)).otherwise(token_f1(output, gold))
    return F.when(expected.isNull(), 0.0).when(f >= 0.5, f).when(says(output, gold), F.greatest(f, F.lit(0.5))).otherwise(f)


def binary_verdict(output: Column, reply: Column) -> Column:
    """struct<score, reason> of a judge's reply, which may have prose around its object; an empty output or an unreadable reply scores 0."""
    found = F.regexp_extract(reply, r"\{[^{}]*\}", 0)
    v = F.when(found != "", F.from_json(found, "is_correct boolean, reason string"))
    empty = ~T.has_text(F.coalesce(output, F.lit("")))
    score = F.when(~empty & F.coalesce(v.getField("is_correct"), F.lit(False)), 1.0).otherwise(0.0)
    reason = F.when(empty, "Empty output").when(found == "", "Judge failed").otherwise(F.coalesce(v.getField("reason"), F.lit("")))
    return F.struct(score.alias("score"), reason.alias("reason"))


def preference_error(violates: Column, acknowledges: Column, hallucinates: Column, helpful: Column) -> Column:
    """How an answer fails a stated preference, from four verdicts."""
    return (
        F.when(violates & ~acknowledges & helpful, "Preference-Unaware Violation")
        .when(violates & acknowledges & hallucinates & helpful, "Preference Hallucination Violation")
        .when(violates & acknowledges & ~hallucinates & helpful, "Inconsistency Violation")
        .when(~violates & ~helpful, "Unhelpful Response")
        .otherwise("Personalized Response")
    )
