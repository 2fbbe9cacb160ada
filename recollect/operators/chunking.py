"""Splitting of texts into chunks: windows of tokens as SQL, structure-aware splitters as Arrow-batched table functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as T


def starts(n: Column, size: int, overlap: int) -> Column:
    """Numbers of the windows over n tokens, from 0; none without tokens."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / (size - overlap)))
    return F.when(n > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """array<array<string>>: windows of ``size`` tokens, each starting ``overlap`` before the end of the one before; the last ends with the text."""
    return F.transform(starts(F.size(tokens), size, overlap), lambda i: F.slice(tokens, i * (size - overlap) + 1, F.lit(size)))


def chunked(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk, text, tokens of each document's windows of white-space tokens; blank and null texts have none."""
    # the generator stands between the splitting of a text and its windows, so that a text is split once
    t = docs.select("doc_id", T.tokens(F.col("text")).alias("t"))
    t = t.select("doc_id", "t", F.explode(starts(F.size("t"), size, overlap)).alias("chunk"))
    w = t.select("doc_id", "chunk", F.slice("t", F.col("chunk") * (size - overlap) + 1, F.lit(size)).alias("w"))
    return w.select("doc_id", "chunk", F.array_join("w", " ").alias("text"), F.size("w").cast("long").alias("tokens"))


def paragraphs(docs: DataFrame) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("chunk", "text"))


def split_by(docs: DataFrame, splitter: Callable[[str], list[str]]) -> DataFrame:
    """doc_id, chunk, text: the pieces a Python splitter makes of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, p) for i, t in zip(pdf["doc_id"], pdf["text"]) if t for k, p in enumerate(splitter(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk int, text string")


SENTENCE = re.compile(r"(?:[^.!?。！？]|[.!?](?!\s|$))*(?:[.!?。！？]+\s*|$)")


def packed(parts: list[str], limit: int, split_one: Callable[[str], list[str]]) -> list[str]:
    """Neighbouring parts put together greedily up to the limit; a part over the limit is split further. Blanks at the ends don't count."""
    out: list[str] = []
    now = ""
    for p in parts:
        if len(p.strip()) > limit:
            out += [now] + split_one(p)
            now = ""
        elif now and len((now + p).strip()) > limit:
            out.append(now)
            now = p
        else:
            now += p
    return [c for c in map(str.strip, [*out, now]) if c]


def by_size(text: str, limit: int) -> list[str]:
    return [text[i : i + limit] for i in range(0, len(text), limit)]


def sentences(text: str) -> list[str]:
    """The sentences with the blanks behind them; joined they give the text."""
    return [s for s in SENTENCE.findall(text) if s]


def after(text: str, separator: str) -> list[str]:
    """The text cut behind each separator; joined the parts give the text."""
    parts = text.split(separator)
    return [p for p in [*(x + separator for x in parts[:-1]), parts[-1]] if p]


def sentence_packer(limit: int) -> Callable[[str], list[str]]:
    return lambda text: packed(sentences(text), limit, lambda s: by_size(s, limit))


def paragraph_packer(limit: int) -> Callable[[str], list[str]]:
    return lambda text: packed(after(text, "\n\n"), limit, sentence_packer(limit))


def recursive_splitter(limit: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> Callable[[str], list[str]]:
    """Cuts behind the first separator present, recursively for parts over the limit; chunks overlap by whole parts and are stretches of the text."""

    def pieces(text: str, seps: tuple[str, ...]) -> list[str]:
        if len(text) <= limit:
            return [text]
        if not seps or seps[0] == "":
            return by_size(text, limit)
        if seps[0] not in text:
            return pieces(text, seps[1:])
        return [q for p in after(text, seps[0]) for q in pieces(p, seps[1:])]

    def run(text: str) -> list[str]:
        out: list[str] = []
        now: list[str] = []
        for p in pieces(text, separators):
            if now and sum(map(len, now)) + len(p) > limit:
                out.append("".join(now))
                while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(p) > limit):
                    now.pop(0)
            now.append(p)
        return [c for c in [*out, "".join(now)] if c.strip()]

    return run


def header_splitter(text: str) -> list[str]:
    """Sections of a markdown text, each with its header line."""
    return [s for s in re.split(r"(?m)^(?=#{1,6}\s)", text) if s.strip()]


def lossless(limit: int) -> Callable[[str], list[str]]:
    """Words make sentences, of up to ``limit`` words, and these paragraphs of up to as many; the pieces joined give the text back exactly.

    A sentence ends with its mark, a paragraph with an empty line or where the next sentence would pass the limit.
    """

    def run(text: str) -> list[str]:
        whole: list[tuple[str, int]] = []
        now, n = "", 0
        for word in re.findall(r"\s*\S+\s*", text) or [text]:
            now, n = now + word, n + 1
            if n >= limit or re.search(r"[.;!?…。；！？][\"'”’)）]*\s*$", word) or "\n\n" in word:
                whole.append((now, n))
                now, n = "", 0
        whole += [(now, n)] if now else []
        out, now, n = [], "", 0
        for sentence, words in whole:
            if now and n + words > limit:
                out.append(now)
                now, n = "", 0
            now, n = now + sentence, n + words
            if "\n\n" in sentence[len(sentence.rstrip()) :]:
                out.append(now)
                now, n = "", 0
        return out + [now] if now else out

    return run


def characters(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk, text: windows of ``size`` characters that share ``overlap``; without UDF."""
    step = size - overlap
    n = F.when(F.length("text") <= size, 1).otherwise(F.ceil((F.length("text") - size) / step) + 1).cast("int")
    t = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return t.select("doc_id", "chunk", F.substring(F.col("text"), F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def semantic_splitter(limit: int) -> Callable[[str], list[str]]:
    """Code blocks, lists and stack traces stay whole; the prose between them is packed by sentences."""

    def run(text: str) -> list[str]:
        out, at = [], 0
        for m in re.finditer(r"```.*?```|(?m:^(?:[ \t]*(?:[-*+]|\d+\.)\s[^\n]*\n?)+)", text, re.S):
            out += sentence_packer(limit)(text[at : m.start()]) if text[at : m.start()].strip() else []
            out.append(m[0])
            at = m.end()
        return out + (sentence_packer(limit)(text[at:]) if text[at:].strip() else [])

    return run


def protected(text: Column) -> Column:
    """struct<masked, urls>: each URL replaced by one control character, which no splitter cuts."""
    return F.struct(F.regexp_replace(F.replace(text, F.lit(MASK), F.lit("")), URL, MASK).alias("masked"), F.regexp_extract_all(text, F.lit(URL), F.lit(0)).alias("urls"))


def restored(masked: Column, urls: Column) -> Column:
    """The text with its URLs back in their places, in order."""
    pieces = F.split(masked, MASK)
    return F.array_join(F.zip_with(pieces, urls, lambda p, u: F.concat(p, F.coalesce(u, F.lit("")))), "")


URL, MASK = r"https?://\S+", "\x01"
