"""Tables out of structured answers in a text column.

An answer has question lines (a mark, then ``question: answer: description``),
a block of shorter lines after them and a verdict in its last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.text import strip

# Number of question lines before the shorter block starts.
QUESTION_LINES = 33


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _fields(line: Column, most: int) -> list[Column]:
    """Parts between ``: ``, the last one with whatever remains; missing ones empty."""
    parts = F.split(line, ": ", most)
    return [F.coalesce(F.try_element_at(parts, F.lit(n + 1)), F.lit("")) for n in range(most)]


def _table(df: DataFrame, key: str, lines: Column, names: tuple[str, ...]) -> DataFrame:
    """One row per line that has a colon, without the line's first character."""
    listed = df.select(F.col(key), F.posexplode(lines).alias("line_no", "line"))
    body = listed.withColumn("line", F.expr("substring(line, 2)")).filter(F.contains("line", F.lit(": ")))
    values = [value.alias(name) for value, name in zip(_fields(F.col("line"), len(names)), names)]
    return body.select(key, "line_no", *values)


def answer_lines(df: DataFrame, key: str, text: str = "text", lines: int = QUESTION_LINES) -> DataFrame:
    """The question lines as question, answer and description."""
    return _table(df, key, F.slice(_lines(text), 1, lines), ("question", "answer", "description"))


def fuel_lines(df: DataFrame, key: str, text: str = "text", after: int = QUESTION_LINES) -> DataFrame:
    """The lines after the questions, without the last, as question and answer."""
    lines = _lines(text)
    between = F.greatest(F.size(lines) - after - 1, F.lit(0))
    return _table(df, key, F.slice(lines, F.lit(after + 1), between), ("question", "answer"))


def verdict_line(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The last line as question, verdict and reason."""
    last = F.array(F.element_at(_lines(text), -1))
    return _table(df, key, last, ("question", "verdict", "reason")).drop("line_no")


def summary_split(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The first paragraph and everything after it."""
    parts = F.split(F.col(text), "\n\n", 2)
    rest = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return df.select(key, strip(parts[0]).alias("summary"), strip(rest).alias("recommendations"))


def token_chunks(df: DataFrame, key: str, text: str = "text", size: int = 1500) -> DataFrame:
    """The text cut into pieces of at most ``size`` words.

    Each row is cut where it is; no words are moved between tasks.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0))
    spaced = df.filter(F.rlike(F.col(text), F.lit(r"\S"))).select(key, words.alias("words"))
    starts = F.sequence(F.lit(1), F.size("words"), F.lit(size))
    pieces = F.transform(starts, lambda s: F.slice(F.col("words"), s, F.lit(size)))
    cut = spaced.select(key, F.posexplode(pieces).alias("chunk_no", "piece"))
    return cut.select(
        key, "chunk_no", F.size("piece").alias("words"), F.array_join("piece", " ").alias("chunk")
    )
