"""Text functions as column expressions. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens per UTF-8 byte.
TOKENS_PER_BYTE = {"en": 0.263, "zh": 0.248}


def lit_or_col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_estimate(text: str | Column, lang: str | Column = "lang", strict: bool = False) -> Column:
    """UTF-8 bytes times the rate of the language, rounded up. Any language but English has the Chinese rate;
    ``strict`` gives null for languages other than en and zh. An empty text has 0 tokens."""
    text, lang = lit_or_col(text), lit_or_col(lang)
    rate = F.when(lang == "en", TOKENS_PER_BYTE["en"])
    rate = rate.when(lang == "zh", TOKENS_PER_BYTE["zh"]) if strict else rate.otherwise(TOKENS_PER_BYTE["zh"])
    return F.ceil(F.octet_length(text) * rate).cast("bigint")


def char_ngrams(text: str | Column, n: int = 3) -> Column:
    """The distinct n-grams of code points; empty if the text is shorter than n."""
    text = lit_or_col(text)
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).when(text.isNotNull(), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def ngram_similarity(a: str | Column, b: str | Column, n: int = 3, head: int | None = None) -> Column:
    """Jaccard index of the n-gram sets, of the first ``head`` characters if given."""
    a, b = lit_or_col(a), lit_or_col(b)
    if head is not None:
        a, b = F.substring(a, 1, head), F.substring(b, 1, head)
    return jaccard(char_ngrams(a, n), char_ngrams(b, n))


def equal_chunks(text: str | Column, tokens: Column, size: int) -> Column:
    """A text of so many tokens in ceil(tokens / size) parts of equal width in characters; never an empty part, and no
    part of a text without characters or tokens."""
    text = lit_or_col(text)
    n = F.ceil(tokens / size)
    width = F.ceil(F.length(text) / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: F.substring(text, i * width + 1, width))
    return F.when((F.length(text) > 0) & (tokens > 0), F.filter(parts, lambda p: p != "")).when(text.isNotNull(), F.array().cast("array<string>"))


def quoted_strings(text: str | Column) -> Column:
    """What stands between double quotes, in order."""
    return F.regexp_extract_all(lit_or_col(text), F.lit('"([^"]*)"'), F.lit(1))


def is_question(text: str | Column) -> Column:
    """Whether the text ends with a question mark."""
    return lit_or_col(text).rlike("[?？]$")


def first_json_object(text: str | Column) -> Column:
    """The first {...} on one line, up to the first closing brace, as a map of strings; null where there is none or it
    isn't valid."""
    return F.from_json(F.nullif(F.regexp_extract(lit_or_col(text), r"(?d)(\{.*?\})", 1), F.lit("")), "map<string,string>")


def strip_characters(text: str | Column, characters: str = "答案：") -> Column:
    """Without any of these characters at both ends."""
    return F.btrim(lit_or_col(text), F.lit(characters))


def strip_space(text: str | Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(lit_or_col(text), r"(?U)^\s+|\s+$", "")


def numbered_passages(docs: Column, lang: Column) -> Column:
    """The contents under numbered headings, joined by line feeds; null contents are empty."""
    return F.array_join(
        F.transform(docs, lambda d, i: F.concat(F.when(lang == "zh", F.concat(F.lit("文章 "), (i + 1).cast("string"), F.lit("：\n"))).otherwise(F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(":\n"))), F.coalesce(d["content"], F.lit("")))),
        "\n",
    )


def qa_text(question: str | Column, answer: str | Column) -> Column:
    return F.concat_ws("\n", lit_or_col(question), lit_or_col(answer))


def question_line(prompt: str | Column) -> Column:
    """The line before the last; null where there are fewer than two, or it has no question label."""
    line = F.try_element_at(F.split(lit_or_col(prompt), "\n"), F.lit(-2))
    return F.when(line.rlike("^(问题|Question)"), line)


def base_name(path: str | Column) -> Column:
    """The last part of a path, up to its first full stop."""
    return F.element_at(F.split(F.element_at(F.split(lit_or_col(path), "/"), -1), r"\."), 1)


def parent_name(path: str | Column) -> Column:
    return F.try_element_at(F.split(lit_or_col(path), "/"), F.lit(-2))


def zero_padded(number: str | Column, width: int = 2) -> Column:
    """At least ``width`` digits."""
    digits = lit_or_col(number).cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
