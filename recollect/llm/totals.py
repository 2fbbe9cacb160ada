"""Problem 2: how many tokens each slice of the dialogues provides, by regression instead of encoding everything.

1. Every session is measured on the JVM: bytes, words, digits, punctuation, Han and other non-ASCII letters, white space and
   messages, over the whole of all its messages.
2. About ``MOST_ENCODED`` sessions, chosen by a hash of their id, are encoded with an existing tokenizer.
3. On three fifths of these, a least-squares regression per language predicts tokens from the measures; a fifth gives the
   ratio by which each language's predictions are corrected; the last fifth shows the error that is left.
4. The models predict every session, and the totals are summed by source, language and category of the persona.

A session counts once however often its row repeats. Null messages and contents weigh nothing. Spellings of source, language
and category are unified; a missing source or category, and a persona that is null or unknown, give 'unknown'. A session's
language is that of its letters (Han or not) if it has twenty, else that of its label, else 'unknown'. A language without
20 encoded sessions takes the regression over all. An empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.encoding import Bpe
from recollect.llm.words import sampled, slices
from recollect.runtime import materialize

MOST_ENCODED = 4_000
LEAST = 20
MEASURES = ("bytes", "words", "digits", "punctuation", "han", "other", "spaces", "messages")
HAN = r"\x{3007}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"


def spelled(c: Column) -> Column:
    """Lower case, with blanks, hyphens and underscores as one underscore; null if nothing is left."""
    s = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.when(s != "", F.regexp_replace(s, " ", "_"))


def language_code(label: Column) -> Column:
    """Two letters: the region is dropped, three-letter codes and names are shortened."""
    s = F.regexp_extract(F.lower(label), r"^\s*([a-z]+)", 1)
    return F.when(s.isin("en", "eng", "english"), "en").when(s.isin("zh", "zho", "chi", "chinese", "cn"), "zh").when(s != "", F.substring(s, 1, 2))


def measured(sessions: DataFrame) -> DataFrame:
    """One row per session row: its key, labels, text and measures."""
    text = F.array_join(F.transform(F.coalesce("messages", F.array().cast(sessions.schema["messages"].dataType)), lambda m: m.content), "\n")
    between = F.greatest(F.size(F.filter(F.coalesce("messages", F.array().cast(sessions.schema["messages"].dataType)), lambda m: m.content.isNotNull())) - 1, F.lit(0))  # line breaks put between messages
    s = sessions.select("session_id", "persona_id", "source", "lang", F.coalesce(F.size("messages"), F.lit(0)).alias("messages"), text.alias("text"), between.alias("_between"), F.col("messages").alias("_messages"))
    less = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    return s.select(
        "*",
        (F.octet_length("text") - F.col("_between")).alias("bytes"),
        F.regexp_count("text", F.lit(r"[A-Za-z]+")).alias("words"),
        less("[0-9]+").alias("digits"),
        less(r"[\p{P}\p{S}]+").alias("punctuation"),
        less(f"[{HAN}]+").alias("han"),
        less(rf"[\x00-\x7f\p{{P}}\p{{S}}{HAN}]+").alias("_kept"),
        (less(r"\s+") - F.col("_between")).alias("spaces"),
        F.length("text").alias("length"),
    ).withColumn("other", F.col("length") - F.col("_kept")).drop("_kept", "_between")


def estimate(sessions: DataFrame, personas: DataFrame, tokenizer: str, most_encoded: int = MOST_ENCODED) -> tuple[DataFrame, DataFrame]:
    """(totals, holdout).

    totals: source, lang, category, sessions, messages, bytes, tokens. holdout: lang, encoded, fitted, ratio, tokens, predicted,
    error: the correction and the relative error on the encoded sessions that took no part in fitting or correcting.
    """
    spark = sessions.sparkSession
    m = measured(sessions)
    letters = F.col("han") + F.col("other") + F.col("words") * 4
    detected = F.when(letters >= 20, F.when(F.col("han") * 2 > F.col("words"), "zh").otherwise(F.when(language_code(F.col("lang")) == "zh", "en").otherwise(F.coalesce(language_code(F.col("lang")), F.lit("en")))))
    m = m.withColumn("lang", F.coalesce(detected, language_code(F.col("lang")), F.lit("unknown")))
    light = ["persona_id", "source", "lang", *MEASURES]
    m = m.withColumn("copy", F.xxhash64(*light, "text"))  # of differing rows of a session the longest counts, for measures and tokens alike
    one = m.groupBy("session_id").agg(F.max_by(F.struct(*light, "copy"), F.struct("bytes", "copy")).alias("s")).select("session_id", "s.*")
    one = materialize(one, "measured")

    parts = spark.sparkContext.broadcast(Bpe.parts(tokenizer))
    chosen = sampled(one.select("session_id", "copy"), ["session_id"], one.count(), most_encoded)
    contents = m.select("session_id", "copy", "_messages").join(chosen, ["session_id", "copy"]).dropDuplicates(["session_id"]).select("session_id", F.explode("_messages").alias("m")).select("session_id", F.col("m.content").alias("text"))
    kind = contents.schema["session_id"].dataType.simpleString()

    def count(batches):
        bpe = Bpe(*parts.value)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.encode(texts)[1])], names=["session_id", "tokens"])

    true = contents.mapInArrow(count, f"session_id {kind}, tokens long").groupBy("session_id").agg(F.sum("tokens").alias("tokens"))
    sample = one.join(true, "session_id").select("lang", "tokens", *MEASURES, F.pmod(F.xxhash64("session_id", F.lit(5)), F.lit(5)).alias("part")).collect()  # about most_encoded rows
    models, report = {}, []
    x = np.array([[r[k] for k in MEASURES] for r in sample], float).reshape(len(sample), len(MEASURES))
    y = np.array([r["tokens"] for r in sample], float)
    part = np.array([r["part"] for r in sample])
    langs = np.array([r["lang"] for r in sample])
    for lang in [None, *sorted(set(langs.tolist()))]:
        mine = np.ones(len(y), bool) if lang is None else langs == lang
        if mine.sum() < LEAST and lang is not None or not mine.any():
            continue
        fit = mine & (part < 3) if (mine & (part < 3)).any() else mine
        scale = 1 / np.sqrt(np.maximum(y[fit], 1))  # the error of a sum grows with its root
        a, b = x[fit] * scale[:, None], y[fit] * scale
        w = np.linalg.solve(a.T @ a + 1e-6 * np.trace(a.T @ a) / a.shape[1] * np.eye(a.shape[1]), a.T @ b)
        fix, test = mine & (part == 3), mine & (part == 4)
        ratio = float(y[fix].sum() / max((x[fix] @ w).sum(), 1e-9)) if y[fix].sum() > 0 else 1.0
        models[lang] = [float(v * ratio) for v in w]
        got = float((x[test] @ w).sum() * ratio)
        report.append((lang or "all", int(mine.sum()), int(fit.sum()), ratio, int(y[test].sum()), got, got / max(float(y[test].sum()), 1.0) - 1))
    dot = lambda w: sum((F.col(k) * F.lit(v) for k, v in zip(MEASURES, w)), F.lit(0.0))
    tokens = dot(models.get(None, [0.0] * len(MEASURES)))
    for lang, w in models.items():
        if lang is not None:
            tokens = F.when(F.col("lang") == lang, dot(w)).otherwise(tokens)
    who = personas.select(F.col("id").alias("persona_id"), spelled(F.col("category")).alias("category")).dropDuplicates(["persona_id"])
    category = F.when(F.col("category") == "rehab", "rehabilitation").otherwise(F.coalesce("category", F.lit("unknown")))
    key = F.regexp_replace(spelled(F.col("source")), "_", "")
    rows = one.withColumn("tokens", F.greatest(tokens, F.lit(0.0))).withColumn("key", key).withColumn("name", spelled(F.col("source")))
    # joined after summing by persona, so that only few rows meet the personas
    sums = rows.groupBy("key", "name", "lang", "persona_id").agg(F.count("*").alias("sessions"), F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))
    names = sums.groupBy("key", "name").agg(F.sum("sessions").alias("n")).groupBy("key").agg(F.max_by("name", F.struct("n", "name")).alias("source"))
    out = sums.join(who, "persona_id", "left").join(names.where("key is not null"), "key", "left")
    out = out.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), "lang", category.alias("category")).agg(*(F.sum(c).alias(c) for c in ("sessions", "messages", "bytes")), F.round(F.sum("tokens")).cast("long").alias("tokens"))
    schema = "lang string, encoded int, fitted int, ratio double, tokens long, predicted double, error double"
    return out, spark.createDataFrame(report, schema)
