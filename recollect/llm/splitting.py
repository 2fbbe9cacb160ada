"""Problem 5: cutting oversized texts into pieces under a limit, at natural boundaries, with overlap.

Method: one regular expression with bounded quantifiers consumes the text up to the limit. Its alternatives are ordered
by the strength of the boundary: paragraph, line, sentence, clause, word, and any character as the fallback; the first
five ask for at least half the limit, so a far stronger boundary near the start doesn't make a tiny piece. Overlap is
looked up backwards: a piece is the last code points of the pieces' text before it, and its own. All of it is SQL on the
JVM: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundary_pattern(most: int) -> str:
    """A Java regular expression whose successive matches partition any text into parts of 1 to ``most`` code points."""
    least = most // 2
    body = lambda low, end: f".{{{low},{most}}}{end}"
    # the boundary itself belongs to the part before it; look-behind keeps its length within the limit
    ends = (
        r"(?<=\n[ \t\r]{0,20}\n)(?!\s)",
        r"(?<=\n)",
        r"(?<=[.!?…]['\")\]]{0,2}\s|[。！？…][”’」』）]{0,2})(?![”’」』）\s])",
        r"(?<=[,;:]\s|[，；：、])",
        r"(?<=\s)(?!\s)",
    )
    strong = [body(least, e) for e in ends]
    weak = [body(1, e) for e in ends[2:]]
    return rf"(?s).{{1,{most}}}\z|" + "|".join(strong + weak) + rf"|.{{1,{most}}}"


def pieces_of(text: Column, limit: int = 1200, overlap: int = 100) -> Column:
    """array<struct<piece_no, start, text>> of a string column; start counts code points from 0.

    Null: null. A text within the limit: itself as the one piece, the empty text included. Every piece but the first
    begins with the last ``overlap`` code points before its own part. Dropping these gives the text back exactly.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    parts = F.regexp_extract_all(text, F.lit(boundary_pattern(limit - overlap)), F.lit(0))
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))
    span = F.transform(parts, lambda p, i: F.struct(i.cast("int").alias("piece_no"), F.greatest(F.get(ends, i) - overlap, F.lit(0)).alias("start"), F.get(ends, i + 1).alias("stop")))
    cut = F.transform(span, lambda s: F.struct(s.piece_no.alias("piece_no"), s.start.alias("start"), F.substring(text, s.start + 1, s.stop - s.start).alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).alias("start"), text.alias("text")))
    return F.when(text.isNull(), F.lit(None).cast("array<struct<piece_no:int,start:int,text:string>>")).when(F.length(text) <= limit, whole).otherwise(cut)


def split_oversized(df: DataFrame, keys: list[str], text_col: str = "content", limit: int = 1200, overlap: int = 100) -> DataFrame:
    """keys, piece_no, start, piece: the pieces of each text over the limit; other rows of ``df`` have none here.

    Repeated rows of a key and text give their pieces once. Null and empty texts, an empty table: no rows.
    """
    long = df.select(*keys, F.col(text_col).alias("_text")).where(F.length("_text") > limit).dropDuplicates([*keys, "_text"])
    return long.select(*keys, F.inline(pieces_of(F.col("_text"), limit, overlap))).withColumnRenamed("text", "piece")
