"""Scalar functions and answer metrics (X, F2, F23, U4, U5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import evaluation as E
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.functions.semantics import extract_json, lcs_length, meteor, nfd, partial_ratio, stem, temporal_match
from recollect.operators.retrieval import lookup_vectors
from recollect.plans.registry import nodes, query, results, sessions, turns, vectors
from recollect.runtime import table

WS = r"[\s\p{Z}\x{0b}\x{85}]+"


def re2(chars: str) -> str:
    return ("[" + "".join("\\" + c if c in "[]\\^-&~|#" else c for c in chars) + "]").replace("'", "''")


def q(s: str) -> str:
    return s.replace("'", "''")


def nt(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '{re2(T.ASCII_PUNCTUATION + T.CJK_PUNCTUATION)}', '', 'g'), '{WS}', '', 'g'))"


def na(x: str) -> str:
    """RE2 knows ASCII word borders alone, so the characters beside an article are matched; twice, as neighbours share one."""
    clean = f"regexp_replace(lower(regexp_replace({x}, ',', '', 'g')), '{re2(T.ASCII_PUNCTUATION)}', '', 'g')"
    for _ in range(2):
        clean = f"regexp_replace({clean}, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(?:a|an|the|and)($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({clean}, '{WS}', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({na(x)}, ' '), lambda w: w <> '')"


def overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda u: u = t)), len(list_filter({b}, lambda u: u = t))))), 0)"


def f1(a: str, b: str) -> str:
    return f"CASE WHEN {overlap(a, b)} > 0 THEN 2.0 * {overlap(a, b)} / (len({a}) + len({b})) ELSE 0 END"


PAIRS = "SELECT query_id, question, model_output AS o, expected[1] AS e, expected FROM results WHERE model_output IS NOT NULL AND expected[1] IS NOT NULL"
TOKENED = f"tokened AS (SELECT query_id, question, o, e, {toks('o')} AS a, {toks('e')} AS b FROM ({PAIRS}))"


def pairs(spark, d):
    e = F.get("expected", 0)
    return results(spark, d).where(F.col("model_output").isNotNull() & e.isNotNull()).select("query_id", "question", F.col("model_output").alias("o"), e.alias("e"), "expected")


def tokened(spark, d):
    return pairs(spark, d).select("query_id", "question", "o", "e", T.answer_tokens(F.col("o")).alias("a"), T.answer_tokens(F.col("e")).alias("b"))


@query("X1_normalize_text", f"SELECT query_id, question, {nt('o')} AS normalized FROM ({PAIRS})", uses="results")
def _(spark, d):
    return pairs(spark, d).select("query_id", "question", T.normalize_text(F.col("o")).alias("normalized"))


LETTERS = r"""list_sort(list_distinct(list_concat(list_concat(regexp_extract_all({x}, '(?:^|[^\p{{L}}\p{{N}}_])([A-F])(?:$|[^\p{{L}}\p{{N}}_])', 1), regexp_extract_all({x}, '选([A-F])', 1)),
    list_concat(regexp_extract_all({x}, '答案[是为：:]*\s*([A-F])', 1), regexp_extract_all({x}, '([A-F])选项', 1)))))"""


@query("X2_option_letters", f"SELECT query_id, question, array_to_string({LETTERS.format(x='upper(o)')}, '') AS letters FROM ({PAIRS}) WHERE length(o) <= 3", uses="results")
def _(spark, d):
    return pairs(spark, d).where("length(o) <= 3").select("query_id", "question", F.array_join(T.option_letters(F.col("o")), "").alias("letters"))


@query(
    "X3_string_contain",
    f"SELECT query_id, question, len(expected) > 0 AND len(list_filter(expected, lambda x: x IS NULL OR {nt('x')} = '' OR NOT contains({nt('o')}, {nt('x')}))) = 0 AS hit FROM ({PAIRS})",
    uses="results",
)
def _(spark, d):
    return pairs(spark, d).select("query_id", "question", F.coalesce(T.contains_all(F.col("o"), F.col("expected")), F.lit(False)).alias("hit"))


@query("X4_exact_match", f"SELECT query_id, question, len(list_filter(expected, lambda x: {nt('x')} = {nt('o')})) > 0 AS hit FROM ({PAIRS})", uses="results")
def _(spark, d):
    return pairs(spark, d).select("query_id", "question", F.coalesce(T.equals_any(F.col("o"), F.col("expected")), F.lit(False)).alias("hit"))


@query(
    "X5_option_match",
    r"""
    SELECT query_id, question, list_sort(list_distinct(list_filter(list_transform(expected, lambda x: regexp_extract(x, '^([A-F])[.、:\s]', 1)), lambda c: c <> '')))
        = CASE WHEN regexp_extract(model_output, '^([A-F])[.、:\s]', 1) = '' THEN [] ELSE [regexp_extract(model_output, '^([A-F])[.、:\s]', 1)] END AS hit
    FROM results WHERE query_type = 'multiple_choice' AND model_output IS NOT NULL AND len(list_filter(expected, lambda x: x IS NULL)) = 0
    """,
    uses="results",
)
def _(spark, d):
    r = results(spark, d).where((F.col("query_type") == "multiple_choice") & F.col("model_output").isNotNull() & ~F.coalesce(F.exists("expected", lambda x: x.isNull()), F.lit(False)))
    return r.select("query_id", "question", T.option_match(F.concat(T.leading_letter(F.col("model_output")), F.lit(" ")), F.col("expected")).alias("hit"))


@query("X6_normalize_answer", f"SELECT query_id, question, {na('o')} AS normalized FROM ({PAIRS})", uses="results")
def _(spark, d):
    return pairs(spark, d).select("query_id", "question", T.normalize_answer(F.col("o")).alias("normalized"))


@query("X8_token_f1", f"SELECT query_id, question, round({f1('a', 'b')}, 6) AS f1 FROM (WITH {TOKENED} SELECT * FROM tokened)", uses="results")
def _(spark, d):
    return tokened(spark, d).select("query_id", "question", F.round(T.f1_of(F.col("a"), F.col("b")), 6).alias("f1"))


@query("X7_stemmed_f1")
def _(spark, d):
    t = tokened(spark, d).select("query_id", "question", stem(F.col("a")).alias("a"), stem(F.col("b")).alias("b"))
    return t.select("query_id", "question", F.round(T.f1_of(F.col("a"), F.col("b")), 6).alias("f1"))


@query(
    "X9_multi_hop_f1",
    f"""
    SELECT query_id, question, round(avg(best), 6) AS f1 FROM (SELECT query_id, question, o, e, i, max({f1('a', 'b')}) AS best FROM (
        SELECT *, {toks('p')} AS a, {toks('g')} AS b FROM (
            SELECT query_id, question, o, e, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE [o] END) AS p, g, i FROM (
                SELECT query_id, question, o, e, list_filter(list_transform(string_split(o, ','), lambda s: trim(s)), lambda s: s <> '') AS ps,
                    unnest(CASE WHEN len(gs) > 0 THEN gs ELSE [e] END) AS g, generate_subscripts(CASE WHEN len(gs) > 0 THEN gs ELSE [e] END, 1) AS i
                FROM (SELECT *, list_filter(list_transform(string_split(e, ','), lambda s: trim(s)), lambda s: s <> '') AS gs FROM ({PAIRS}))))) GROUP BY ALL) GROUP BY query_id, question, o, e
    """,
    uses="results",
)
def _(spark, d):
    return pairs(spark, d).select("query_id", "question", F.round(E.multi_hop_f1(F.col("o"), F.col("e")), 6).alias("f1"))


POLAR = " OR ".join(f"(le IN ('{p}', 'likely {p}') AND (starts_with(lo, '{p}') OR starts_with(lo, 'likely {p}')))" for p in ("yes", "no"))
SAYS = f"contains(lo, le) OR contains({na('o')}, {na('e')}) OR {POLAR}"


@query("X10_says", f"SELECT query_id, question, {SAYS} AS hit FROM (SELECT *, lower(trim(o)) AS lo, lower(trim(e)) AS le FROM ({PAIRS}))", uses="results")
def _(spark, d):
    return pairs(spark, d).select("query_id", "question", E.says(F.col("o"), F.col("e")).alias("hit"))


@query(
    "X11_enhanced_f1",
    f"""
    SELECT query_id, question, round(CASE WHEN f >= 0.5 THEN f WHEN {SAYS} THEN greatest(f, 0.5) ELSE f END, 6) AS f1
    FROM (SELECT *, lower(trim(o)) AS lo, lower(trim(e)) AS le, {f1('a', 'b')} AS f FROM (WITH {TOKENED} SELECT * FROM tokened))
    """,
    uses="results",
)
def _(spark, d):
    t = tokened(spark, d).withColumn("f", T.f1_of(F.col("a"), F.col("b")))
    return t.select("query_id", "question", F.round(F.when(F.col("f") >= 0.5, F.col("f")).when(E.says(F.col("o"), F.col("e")), F.greatest("f", F.lit(0.5))).otherwise(F.col("f")), 6).alias("f1"))


NEG = " OR ".join(f"contains(lower(model_output), '{q(p)}')" for p in T.NEGATIVE_PHRASES)


@query("X13_adversarial", f"SELECT query_id, question, CASE WHEN {NEG} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM results WHERE model_output IS NOT NULL", uses="results")
def _(spark, d):
    return results(spark, d).where("model_output is not null").select("query_id", "question", F.when(T.says_nothing(F.col("model_output")), 1.0).otherwise(0.0).alias("score"))


@query("F23_negative_answers", f"SELECT query_type, count(*) AS n, count(*) FILTER (WHERE {NEG}) AS negative FROM results GROUP BY 1", uses="results")
def _(spark, d):
    return results(spark, d).groupBy("query_type").agg(F.count("*").alias("n"), F.count_if(T.says_nothing(F.col("model_output"))).alias("negative"))


def words_to_digits(x: str) -> str:
    for k, w in enumerate(T.NUMBER_WORDS):
        x = f"regexp_replace({x}, '\\b{w}\\b', '{k}', 'g')"
    return x


@query("X14_number_words", f"SELECT event_id, {words_to_digits('event')} AS digits FROM nodes WHERE regexp_matches(event, '^[ -~]*$')", uses="nodes")
def _(spark, d):
    return nodes(spark, d).where(F.col("event").rlike("^[ -~]*$")).select("event_id", T.number_words(F.col("event")).alias("digits"))


@query("X15_date_match")
def _(spark, d):
    n = nodes(spark, d)
    return n.select("event_id", temporal_match(F.col("event_date"), F.col("start_date")).alias("same"))


@query("X16_temporal_score")
def _(spark, d):
    p = pairs(spark, d)
    f = E.token_f1(F.col("o"), F.col("e"))
    return p.select("query_id", "question", F.round(F.when(f >= 0.5, f).when(temporal_match(F.col("o"), F.col("e")), 0.5).otherwise(f), 6).alias("score"))


@query("X17_token_sets", "SELECT query_id, question, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS hit FROM (WITH " + TOKENED + " SELECT * FROM tokened)", uses="results")
def _(spark, d):
    s = lambda c: F.array_sort(F.array_distinct(c))
    return tokened(spark, d).select("query_id", "question", (s("a") == s("b")).alias("hit"))


@query("X18_has_answer")
def _(spark, d):
    def parts(c):
        return F.concat(F.lit("\x01"), F.array_join(F.regexp_extract_all(F.lower(nfd(c)), F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"), F.lit(0)), "\x01"), F.lit("\x01"))

    return pairs(spark, d).select("query_id", "question", F.contains(parts(F.col("question")), parts(F.col("o"))).alias("hit"))


@query(
    "X19_evidence_recall",
    """
    SELECT query_id, round(CASE WHEN len(e) = 0 OR len(c) = 0 THEN 1.0 ELSE len(list_filter(e, lambda x: list_contains(c, x))) / CAST(len(e) AS DOUBLE) END, 6) AS recall FROM (
        SELECT DISTINCT query_id, list_transform(coalesce(source_key_points, []), lambda k: 'D' || k.session_id) AS e,
            list_transform(coalesce(metadata.reasoning_chain, []), lambda n: 'D' || n.session_id) AS c FROM queries)
    """,
)
def _(spark, d):

    t = table(spark, d, "queries").select("query_id", F.transform("source_key_points", lambda k: F.concat(F.lit("D"), k.session_id.cast("string"))).alias("e"), F.transform("metadata.reasoning_chain", lambda n: F.concat(F.lit("D"), n.session_id.cast("string"))).alias("c")).distinct()
    return t.select("query_id", F.round(E.evidence_recall(F.coalesce("e", F.array().cast("array<string>")), F.coalesce("c", F.array().cast("array<string>"))), 6).alias("recall")).distinct()


ROUGE = lambda n: f"""CASE WHEN len(x{n}) > 0 AND len(y{n}) > 0 AND {overlap(f'x{n}', f'y{n}')} > 0 THEN 2.0 * {overlap(f'x{n}', f'y{n}')} / (len(x{n}) + len(y{n})) ELSE 0 END"""
GRAMS = "CASE WHEN len({a}) >= 2 THEN list_transform(range(1, len({a})), lambda i: {a}[i] || ' ' || {a}[i + 1]) ELSE [] END"


@query(
    "X20_rouge",
    f"SELECT query_id, question, round({ROUGE(1)}, 6) AS rouge1, round({ROUGE(2)}, 6) AS rouge2 FROM (SELECT query_id, question, a AS x1, b AS y1, {GRAMS.format(a='a')} AS x2, {GRAMS.format(a='b')} AS y2 FROM (WITH {TOKENED} SELECT * FROM tokened))",
    uses="results",
)
def _(spark, d):
    t = tokened(spark, d)
    return t.select("query_id", "question", F.round(T.f1_of(F.col("a"), F.col("b")), 6).alias("rouge1"), F.round(T.f1_of(T.ngrams(F.col("a"), 2), T.ngrams(F.col("b"), 2)), 6).alias("rouge2"))


@query("X20_bleu_rougel_meteor")
def _(spark, d):
    t = tokened(spark, d)
    lcs = lcs_length(F.col("a"), F.col("b"))
    rl = F.when(lcs > 0, 2.0 * lcs / (F.size("a") + F.size("b"))).otherwise(0.0)
    return t.select("query_id", "question", *(F.round(E.bleu(F.col("a"), F.col("b"), n), 6).alias(f"bleu{n}") for n in (1, 2, 4)), F.round(rl, 6).alias("rougel"), F.round(meteor(F.col("a"), F.col("b")), 6).alias("meteor"))


@query(
    "X21_set_f1",
    f"""
    SELECT query_id, question, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(list_distinct(a)) + len(list_distinct(b))) ELSE 0 END, 6) AS f1
    FROM (SELECT query_id, question, {"list_filter(regexp_split_to_array(lower(regexp_replace(o, '[.,!?]', ' ', 'g')), '" + WS + "'), lambda w: w <> '')"} AS a,
        {"list_filter(regexp_split_to_array(lower(regexp_replace(e, '[.,!?]', ' ', 'g')), '" + WS + "'), lambda w: w <> '')"} AS b FROM ({PAIRS}))
    """,
    uses="results",
)
def _(spark, d):
    part = lambda c: T.tokens(F.lower(F.regexp_replace(c, "[.,!?]", " ")))
    return pairs(spark, d).select("query_id", "question", F.round(T.set_f1(part("o"), part("e")), 6).alias("f1"))


@query(
    "X23_chain_score",
    """
    SELECT query_id, round((0.35 * n + 0.35 * c + 0.30 * k) * CASE WHEN informed THEN 1.0 ELSE 0.5 END * CASE coalesce(difficulty, 'none')
        WHEN 'excellent' THEN 1.0 WHEN 'good' THEN 0.9 WHEN 'partial' THEN 0.7 WHEN 'poor' THEN 0.4 WHEN 'none' THEN 0.1 ELSE 0.5 END, 6) AS score
    FROM (SELECT DISTINCT query_id, coalesce(len(metadata.reasoning_chain), 0) / 10.0 AS n, coalesce(metadata.hop_count, 0) / 10.0 AS c, coalesce(len(metadata.required_memory_nodes), 0) / 10.0 AS k,
        persona_id IS NOT NULL AS informed, metadata.difficulty AS difficulty FROM queries)
    """,
)
def _(spark, d):
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) / 10.0
    t = table(spark, d, "queries").select("query_id", size("metadata.reasoning_chain").alias("n"), (F.coalesce("metadata.hop_count", F.lit(0)) / 10.0).alias("c"), size("metadata.required_memory_nodes").alias("k"), F.col("persona_id").isNotNull().alias("informed"), F.col("metadata.difficulty").alias("difficulty")).distinct()
    return t.select("query_id", F.round(E.chain_score(*map(F.col, ("n", "c", "k", "informed", "difficulty"))), 6).alias("score"))


@query("X25_balanced_json")
def _(spark, d):
    e = table(spark, d, "events").where("props is not null")
    prose = F.concat(F.lit("verdict {not json} ... "), F.col("props"), F.lit(" {\"tail\": \"}\"}"))
    return e.select("event_id", extract_json(F.concat(F.lit("The verdict: "), F.col("props"), F.lit(" and {more}"))).alias("json"), extract_json(prose).alias("first"))


@query("X26_han_share", r"SELECT doc_id, round(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / greatest(length(text), 1), 6) AS share FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(T.han_share(F.col("text")), 6).alias("share"))


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("X27_keyword_tokens", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP})), ' ') AS tokens FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[ -~\n]*$')")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("^[ -~\n]*$")).select("doc_id", F.array_join(T.keyword_tokens(F.col("text")), " ").alias("tokens"))


@query(
    "X28_cosine",
    "SELECT vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) AS cosine, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM vecs, (SELECT v AS w FROM vecs WHERE vec_id = 0)",
    uses="vecs",
)
def _(spark, d):
    v = vectors(spark, d)
    one = lookup_vectors(v, F.col("vec_id") == 0)
    return v.select("vec_id", F.round(V.cosine(F.col("v"), one[0]), 6).alias("cosine"), F.round(V.norm(F.col("v")), 6).alias("norm"))


CH = lambda x: f"list_distinct(list_filter(string_split({x}, ''), lambda t: t <> ''))"
BG = lambda x: f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"


@query(
    "X29_text_similarity",
    f"""
    SELECT query_id, question, round(CASE WHEN len({CH('o')}) + len({CH('e')}) > 0 THEN 2.0 * len(list_intersect({CH('o')}, {CH('e')})) / (len({CH('o')}) + len({CH('e')})) ELSE 0 END, 6) AS dice,
        round(CASE WHEN len({BG('o')}) + len({BG('e')}) > 0 THEN len(list_intersect({BG('o')}, {BG('e')})) / CAST(len(list_distinct(list_concat({BG('o')}, {BG('e')}))) AS DOUBLE) ELSE 0 END, 6) AS bigram
    FROM ({PAIRS}) WHERE regexp_matches(o || e, '^[ -~]*$')
    """,
    uses="results",
)
def _(spark, d):
    p = pairs(spark, d).where(F.concat("o", "e").rlike("^[ -~]*$"))
    return p.select("query_id", "question", F.round(T.dice_chars(F.col("o"), F.col("e")), 6).alias("dice"), F.round(T.bigram_jaccard(F.col("o"), F.col("e")), 6).alias("bigram"))


@query("X29_combined_similarity")
def _(spark, d):
    o, e = F.col("o"), F.col("e")
    return pairs(spark, d).select("query_id", "question", F.round(0.40 * T.dice_chars(o, e) + 0.35 * T.tfidf_chars(o, e) + 0.25 * T.bigram_jaccard(o, e), 6).alias("similarity"))


PHASES = 5


@query(
    "X30_event_phase",
    f"""
    SELECT event_id, CASE WHEN days IS NULL OR days < 0 OR coalesce(time_span_days, 0) < {PHASES} THEN 1 ELSE least(greatest(days // (time_span_days // {PHASES}) + 1, 1), {PHASES}) END AS phase
    FROM (SELECT event_id, time_span_days, CAST(date_diff('day', CASE WHEN regexp_matches(start_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(start_date AS DATE) END, CASE WHEN regexp_matches(event_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(event_date AS DATE) END) AS INT) AS days FROM nodes)
    """,
    uses="nodes",
)
def _(spark, d):
    iso = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    days = F.datediff(iso("event_date"), iso("start_date"))
    span = F.col("time_span_days")
    phase = F.least(F.greatest(F.expr(f"try_divide(cast(days as double), floor(time_span_days / {PHASES}))"), F.lit(0.0)), F.lit(float(PHASES)))
    n = nodes(spark, d).withColumn("days", days)
    return n.select("event_id", F.when(F.col("days").isNull() | (F.col("days") < 0) | (F.coalesce(span, F.lit(0)) < PHASES), 1).otherwise(F.least(F.floor(phase).cast("int") + 1, F.lit(PHASES))).alias("phase"))


@query("X32_timestamp_render", "SELECT session_id, strftime(try_cast(created_at[1:10] AS DATE), '%Y/%m/%d (%a) 00:00') AS stamp FROM sess WHERE regexp_matches(created_at, '^\\d{4}-\\d{2}-\\d{2}')", uses="sess")
def _(spark, d):
    day = F.try_to_date(F.left("created_at", F.lit(10)), "yyyy-MM-dd")
    return sessions(spark, d).where(F.col("created_at").rlike(r"^\d{4}-\d{2}-\d{2}")).select("session_id", F.date_format(day, "yyyy/MM/dd (E) '00:00'").alias("stamp"))


@query("X33_render_memory", "SELECT session_id, string_agg(role || ': ' || coalesce(content, ''), chr(10) ORDER BY turn, role, content) AS memory FROM turns GROUP BY 1", uses="turns")
def _(spark, d):
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    g = turns(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", line.alias("line")))).alias("t"))
    return g.select("session_id", F.array_join(F.transform("t", lambda x: x.line), "\n").alias("memory"))


@query("X35_marker_query", r"SELECT query_id, question, regexp_extract(question, '(?s)[.。;；!！]\s*([^.。;；!！]*[?？])\s*$', 1) AS asked FROM results WHERE question IS NOT NULL", uses="results")
def _(spark, d):
    return results(spark, d).where("question is not null").select("query_id", "question", F.regexp_extract("question", r"(?s)[.。;；!！]\s*([^.。;；!！]*[?？])\s*$", 1).alias("asked"))


@query("X36_preview", "SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS preview FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("X38_name_key", f"SELECT DISTINCT name, lower(regexp_replace(trim(regexp_replace(name, '{re2(T.ASCII_PUNCTUATION)}', '', 'g')), '\\s+', '_', 'g')) AS key FROM kps", uses="kps")
def _(spark, d):
    return table(spark, d, "key_points").select("name").distinct().select("name", T.name_key(F.col("name")).alias("key"))


@query("X39_importance", "SELECT user_id, event_type, round(0.9 * max(value) + 0.05 * least(count(*) * 0.05, 5) + 0.05 * least(count(DISTINCT ts) * 0.05, 2), 6) AS importance FROM events GROUP BY 1, 2")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("s"), F.count("*").alias("k"), F.countDistinct("ts").alias("r"))
    return g.select("user_id", "event_type", F.round(0.9 * F.col("s") + 0.05 * F.least(F.col("k") * 0.05, F.lit(5)) + 0.05 * F.least(F.col("r") * 0.05, F.lit(2)), 6).alias("importance"))


@query("X42_option_decode", "SELECT query_id, question, CASE WHEN length(trim(model_output)) = 1 THEN upper(trim(model_output)) WHEN length(trim(model_output)) = 3 THEN upper(trim(model_output)[2:2]) ELSE model_output END AS option FROM results WHERE model_output IS NOT NULL", uses="results")
def _(spark, d):
    o = F.trim("model_output")
    return results(spark, d).where("model_output is not null").select("query_id", "question", F.when(F.length(o) == 1, F.upper(o)).when(F.length(o) == 3, F.upper(F.substring(o, 2, 1))).otherwise(F.col("model_output")).alias("option"))


@query("X43_token_estimate", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS by_four, CAST(floor(length(text) / 3) AS BIGINT) AS by_three FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.estimated_tokens(F.col("text")).alias("by_four"), T.estimated_tokens(F.col("text"), 3).alias("by_three"))


@query("U5_multiset_overlap", f"SELECT query_id, question, CAST({overlap('a', 'b')} AS BIGINT) AS same FROM (WITH {TOKENED} SELECT * FROM tokened)", uses="results")
def _(spark, d):
    return tokened(spark, d).select("query_id", "question", T.multiset_overlap(F.col("a"), F.col("b")).cast("long").alias("same"))


@query("T16_fuzzy_ratio")
def _(spark, d):
    return pairs(spark, d).select("query_id", "question", F.round(partial_ratio(F.lower("o"), F.lower("e")), 6).alias("ratio"))
