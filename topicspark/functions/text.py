"""Text, array and vector functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a letter word at least, and what ends a word.
LEAST_LETTERS, WORD_END = 3, r"[^\pL\pN_]+"


def words(text: Column) -> Column:
    """Whitespace-separated words, at any Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def letter_words(text: Column, least: int = LEAST_LETTERS) -> Column:
    """Lower-cased words of at least so many letters and nothing but letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<![\p{{L}}\p{{N}}_])\p{{L}}{{{least},}}+(?![\p{{L}}\p{{N}}_])"), F.lit(0))


def chunks(text: Column, most: int = 500, separator: str = "\n\n", count=word_count) -> Column:
    """Greedy runs of paragraphs of up to `most` tokens each; a larger paragraph is a chunk of its own, and an empty text is one
    empty chunk. `count` gives a paragraph's tokens."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def put(a, p):
        n = count(p)
        fits = a["open"].isNotNull() & (a["n"] + n <= most)
        grown = F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit(separator), p).alias("open"), (a["n"] + n).alias("n"))
        closed = F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        return F.when(fits, grown).otherwise(F.struct(closed.alias("done"), p.alias("open"), n.alias("n")))

    parts = F.split(F.coalesce(text, F.lit("")), separator)
    return F.aggregate(parts, start, put, lambda a: F.concat(a["done"], F.array(a["open"])))


def text_chunks(text: str, most: int, separator: str, count) -> list[str]:
    """What `chunks` makes of a text, for use inside a task; `count` is a function of a string."""
    done, n = [], 0
    for paragraph in text.split(separator):
        more = count(paragraph)
        if done and n + more <= most:
            done[-1].append(paragraph)
            n += more
        else:
            done.append([paragraph])
            n = more
    return [separator.join(x) for x in done]


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def string_list(json: Column) -> Column:
    """A JSON array of strings; null gives an empty array."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
