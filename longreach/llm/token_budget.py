"""Token counts per document, and budgets per type, language and domain.

Documents above ``chunk_bytes`` are cut only where a tokenizer provably never joins what stands on both sides, so the
counts of the chunks add up exactly to the count of the document:

* ``rate``: tokens are bytes times a rate, rounded up once per document. Bytes add up over any cut between characters.
* ``byte_bpe_50k``, ``byte_bpe_multi_50k``: the pre-tokenizer never puts a letter and a following line feed into one
  piece, and a run of white space is split by what stands around it, never beyond it. A cut directly after a line feed
  that follows a character which isn't white space, and is followed by a character which isn't white space either,
  therefore separates pieces; so does one before a space between two letters, since a piece's optional leading space
  belongs to the letters behind it. A letter and a mark beside it, in either order, are never of one piece, the
  apostrophe aside; that cuts Chinese, which has no spaces, at its commas and full stops.

Chunks are spread over the workers by a hash of document and chunk number, counted, and summed per document.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_arrow, rate_tokens, with_rate

CHUNK_BYTES = 65_536
TOKENIZER_DIR = "/opt/tokenizers"
# Between two ASCII letters around one space, around one line feed between characters that aren't white space, or between
# a letter (ASCII or the first block of Chinese) and a mark.
_LETTER, _MARK = "A-Za-z一-龥", ".,!?;:()，。！？；：、（）《》“”"
_CUT = re.compile(rf"(?<=[A-Za-z])(?= [A-Za-z])|(?<=\S\n)(?=\S)|(?<=[{_LETTER}])(?=[{_MARK}])|(?<=[{_MARK}])(?=[{_LETTER}])")
_WINDOW = 4096


@lru_cache(4)
def encoding(tokenizer: str, folder: str = TOKENIZER_DIR):
    """A byte-level BPE of a vocabulary file; its pattern is the public one that the vocabulary was made with."""
    import base64

    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(f"{folder}/{tokenizer}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(tokenizer, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int, rate: bool) -> list[str]:
    """Pieces of about ``size`` characters that the measure counts independently; one piece where there is no such
    boundary."""
    out, start = [], 0
    while len(text) - start > size:
        cut = start + size
        if not rate:
            found = None
            at = cut
            while found is None and at < len(text):
                m = _CUT.search(text, at, min(len(text), at + _WINDOW))
                # a lookahead can't see beyond the end of its window
                found = m.start() if m else None
                at += _WINDOW - 2
            if found is None:
                break
            cut = found
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


def token_counts(documents: DataFrame, keys: list[str], measure: str = "rate", chunk_bytes: int = CHUNK_BYTES, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(keys..., n_units): per row of ``documents`` (keys, text) its bytes (``rate``) or tokens (any other measure).

    A null text has 0 units. Rows up to ``chunk_bytes`` are counted where they are; longer ones are cut, their chunks
    spread over the workers and summed. Repeated keys are summed, so keys should be unique."""
    rate = measure == "rate"
    cols = [*keys, "text"]
    small = documents.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk_bytes).select(*cols)
    large = documents.where(F.octet_length("text") > chunk_bytes).select(*cols)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, parts, numbers = [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            for k, piece in enumerate(chunks(t, chunk_bytes // 4, rate)):
                rows.append(i)
                parts.append(piece)
                numbers.append(k)
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(parts, pa.string()), pa.array(numbers, pa.int32())], names=[*cols, "_chunk"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keys).schema)
    pieces = map_arrow(large, cut, f"{fields}, text string, _chunk int").repartition(F.xxhash64(*keys, "_chunk"))

    def counted(df: DataFrame) -> DataFrame:
        if rate:
            return df.select(*keys, F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_units"))

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            enc = encoding(measure, folder)
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n, pa.int64())], names=[*keys, "n_units"])

        return map_arrow(df.select(*cols), count, f"{fields}, n_units bigint")

    summed = counted(pieces).groupBy(*keys).agg(F.sum("n_units").alias("n_units"))
    return counted(small).unionByName(summed)


# ---- languages ---------------------------------------------------------------------------------------------------
# Usual codes and names of the languages at hand.
LANGUAGE_NAMES = {
    "en": "en eng english anglais englisch inglés ingles 英语 英文",
    "zh": "zh zho chi cmn yue wuu chinese mandarin 中文 汉语 漢語 华语 國語 国语 普通话 chinois chinesisch chino",
    "de": "de deu ger german deutsch allemand alemán aleman 德语 德文",
    "fr": "fr fra fre french français francais französisch francés frances 法语 法文",
    "es": "es spa spanish español espanol castellano espagnol spanisch 西班牙语 西班牙文",
}
_MARKS = {
    "en": "the of and was were is did does what which who whose whom how why where when in from by to that at",
    "de": "der die das und wer was welche welcher welches wie warum wo wann ist war wurde von aus mit zu nach im",
    "fr": "le la les et qui quel quelle quels quelles comment pourquoi où quand est était des du de dans par en",
    "es": "el la los las y quién qué cuál cuáles cómo dónde cuándo cuánto cuántos por es fue era del de en con",
}


def _bare(label: F.Column) -> F.Column:
    """Without white space at both ends."""
    return F.regexp_replace(label, r"(?U)^\s+|\s+$", "")


def named_language(label: F.Column) -> F.Column:
    """The language that a label names: a usual code or name, in any case, with any region or script suffix; null where
    it names none of those known."""
    label = _bare(label)
    first = F.lower(F.element_at(F.split(label, r"[-_\s(（.,@/]"), 1))
    table = [x for k, names in LANGUAGE_NAMES.items() for n in names.split() for x in (F.lit(n), F.lit(k))]
    simplified = F.lower(label).rlike("^(simplified|traditional|mandarin|modern standard)[ _-]chinese$|^(简体|繁体|繁體)中?文?$")
    return F.when(simplified, F.lit("zh")).otherwise(F.try_element_at(F.create_map(*table), first))


def text_language(text: F.Column) -> F.Column:
    """zh, en, de, fr or es: Chinese by its characters, else the language with the most function words; null without
    letters. Names in another script don't count: Chinese wins where a quarter of the letters are Chinese."""
    han = F.length(F.regexp_replace(text, r"[^㐀-鿿]", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    words = F.split(F.lower(text), r"[^\p{L}]+")
    among = lambda marks: lambda w: w.isin(*marks.split())
    score = {k: F.size(F.filter(words, among(v))) for k, v in _MARKS.items()}
    best = F.greatest(*score.values())
    latin = F.coalesce(*(F.when(score[k] == best, F.lit(k)) for k in score))
    return F.when(han * 4 >= letters, F.when(letters > 0, F.lit("zh"))).when(letters > 0, latin)


# ---- the project's tables ----------------------------------------------------------------------------------------
def wrong_counts(items: DataFrame, rates: DataFrame) -> DataFrame:
    """(item_id) of the items whose ``token_count`` is null or differs from the token size of their texts."""
    keyed = with_rate(items, F.col("language"), rates).select(
        F.struct("item_id", "token_count", "_rate").alias("key"), F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("output", F.lit(""))).alias("text")
    )
    sizes = token_counts(keyed, ["key"])
    return sizes.where(~F.col("key.token_count").eqNullSafe(rate_tokens(F.col("n_units"), F.col("key._rate")))).select("key.item_id")


def wrong_languages(dataset: DataFrame) -> DataFrame:
    """(row_id) of the rows whose ``language`` is null, blank or doesn't name the language of ``question``. Where the
    question has no letters, only null and blank labels are wrong."""
    asked = text_language(F.col("question"))
    return dataset.where(F.col("language").isNull() | (_bare(F.col("language")) == "") | (asked.isNotNull() & ~named_language(F.col("language")).eqNullSafe(asked))).select("row_id")


def budget(dataset: DataFrame, items: DataFrame, rates: DataFrame, measure: str = "rate", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(tbl, type, language, domain, n_rows, n_tokens) over the texts of both tables.

    A text of ``dataset`` is its passages, question and answer; one of ``dataset_item`` its prompt and output. The
    language is that of the question, and the label's only where the question has no letters; what is still unknown is
    ``und``. Null types and domains are groups of their own. Sums are made per task before the shuffle, so hot slices
    don't matter. ``measure`` is ``rate`` or a tokenizer file of ``folder``."""
    label = lambda asked, named: F.coalesce(text_language(asked), named_language(named), F.lit("und"))
    passages = F.array_join(F.transform(F.coalesce("all_docs", F.array()), lambda d: F.coalesce(d["content"], F.lit(""))), "\n")
    rows = dataset.select(
        F.struct(F.lit("dataset").alias("tbl"), F.col("row_id").alias("rec"), F.col("type"), label(F.col("question"), F.col("language")).alias("language"), F.lit(None).cast("string").alias("domain")).alias("key"),
        F.concat_ws("\n", passages, "question", "answer").alias("text"),
    ).unionByName(
        items.select(
            F.struct(F.lit("dataset_item").alias("tbl"), F.col("item_id").alias("rec"), F.col("type"), label(F.col("mqa.question"), F.col("language")).alias("language"), F.col("domain")).alias("key"),
            F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("output", F.lit(""))).alias("text"),
        )
    )
    sizes = token_counts(rows, ["key"], measure, folder=folder)
    if measure == "rate":
        sizes = with_rate(sizes, F.col("key.language"), rates).withColumn("n_units", rate_tokens(F.col("n_units"), F.col("_rate")))
    slices = sizes.groupBy("key.tbl", "key.type", "key.language", "key.domain").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_units").alias("n_tokens"))
    return slices


def _check_additive(text: str, size: int, enc) -> bool:
    """Whether the chunks of a text count as the text does; used by the tests."""
    return int(np.sum([len(enc.encode_ordinary(p)) for p in chunks(text, size, False)])) == len(enc.encode_ordinary(text))
