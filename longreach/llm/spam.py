"""Keyword-stuffed and link-list pages, told by the shapes of their lines.

A line is cut into stretches after sentence ends. Each stretch is reduced to a shape: script, number of words,
capitals, separators, links, a sentence end, and the part of its words that sentences have and lists lack. Which words
those are is learned from the crawl itself: stretches are grouped by their outer shapes over all documents, and the
words of clear sentence shapes are held against those of clear list shapes. The stretches of a page are grouped by shape,
and a page is flagged if few shapes that aren't sentences hold more than half of its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import table
from .text import map_arrow

LINK = re.compile(r"<a\s[^>]*>.*?</a>|!?\[[^\]\n]*\]\([^)\s]*\)|\b(?:https?|ftp)://[^\s，、；]+|\bwww\.[^\s，、；]+|(?<![\w@.])(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s，、；]*)?(?![\w.])", re.I)
_END = re.compile(r"[.!?](?=\s)|[。！？]")
_DOTTED = re.compile(r"\.[A-Za-z]{2}")
_CAPITAL = re.compile(r"[A-ZÀ-Þ]")
_ENDS = frozenset(".!?。！？…")
_CLOSERS = frozenset("\"'”’)）」』]")
_HAN = re.compile(r"[㐀-鿿]")
_SEPARATORS = (*",;|/>•·#，、；｜*=+~\t", " - ")
_TAGGED = re.compile(r"(?<!\w)#[^\W\d][\w-]*|\b[A-Z]{2,5}[- ]?\d{3,}\b")  # hash tags and article codes
_DIGIT = re.compile(r"\d{3}")
_EDGE = ".,;:!?\"'()[]“”‘’«»¿¡"


VOCABULARY = 20_000  # words of sentences that are learned at most, the most frequent ones


class Shape(NamedTuple):
    script: str
    words: int
    capitals: int
    separators: int
    links: int
    ended: bool
    grammar: int

    @property
    def sentence(self) -> bool:
        """Whether text of this shape is a sentence or a harmless piece of one."""
        if self.links >= 2:
            return False
        if self.grammar == 0:
            return self.ended and (self.separators == 0 and self.words >= 2 or self.script == "han" and self.separators < 2 and self.words >= 1)
        if self.grammar == 1:
            return self.separators < 2 or self.ended and self.words < 3
        return True

    @property
    def outline(self) -> str | None:
        """What the outer shape alone tells: ``plain`` text, ``listed`` items, or nothing."""
        if self.links >= 2 or self.separators == 2 and not self.ended:
            return "listed"
        if self.ended and self.links == 0 and self.words >= 1 and self.separators < (2 if self.script == "han" else 1):
            return "plain"
        return None


def units(bare: str, han: bool) -> list[str]:
    """What grammar is learned from: the words of a stretch, or its Chinese characters."""
    return _HAN.findall(bare) if han else [w.strip(_EDGE) for w in bare.lower().split()]


def shape(stretch: str, known: frozenset[str] = frozenset()) -> tuple[Shape, list[str]]:
    """The shape of a stretch, and its units. Numbers are classes, 0 the lowest; ``grammar`` is the class of the part of
    the units that are ``known`` as words of sentences."""
    bare, linked = stretch, 0
    if "<a" in stretch or "](" in stretch or "://" in stretch or _DOTTED.search(stretch):
        bare = LINK.sub(" ", stretch)
        linked = len(stretch) - len(bare)
    tags = len(_TAGGED.findall(bare)) if "#" in bare or _DIGIT.search(bare) else 0
    han = 0 if bare.isascii() else len(_HAN.findall(bare))
    separators = sum(map(bare.count, _SEPARATORS))
    body = bare.rstrip()
    ended = body[-1:] in _ENDS or body[-2:-1] in _ENDS and body[-1:] in _CLOSERS
    capital = 0
    in_han = han * 3 > len(bare) or bool(han) and han * 2 > len(bare) - bare.count(" ")
    parts = units(bare, in_han)
    n = max(1, len(parts))
    marks = sum(map(known.__contains__, parts)) / n
    if in_han:
        script = "han"
        size = 0 if n < 5 else 1 if n < 15 else 2 if n < 60 else 3
        rate = separators / max(1.0, n / 6)
    else:
        script = "latin"
        size = 0 if n < 3 else 1 if n < 8 else 2 if n < 40 else 3
        rate = separators / max(1.0, n / 4)
        share = len(_CAPITAL.findall(bare)) / n
        capital = 0 if share < 0.05 else 1 if share < 0.6 else 2
    grammar = 0 if marks < 0.1 else 1 if marks < 0.2 else 2
    if tags * 8 > n and tags > 1:
        rate = max(rate, 1.0)
        grammar = 0
    link = 0 if not linked else 1 if linked < len(stretch) * 0.3 else 2
    return Shape(script, size, capital, 0 if rate < 0.2 else 1 if rate < 0.6 else 2, link, ended, grammar), parts


def stretches(text: str) -> list[str]:
    out = []
    for line in text.splitlines():
        start = 0
        for m in _END.finditer(line):
            out.append(line[start : m.end()])
            start = m.end()
        out.append(line[start:])
    return [s for s in out if s and not s.isspace()]


def learned(documents: DataFrame, least_share: float = 0.001, times: float = 8.0) -> frozenset[str]:
    """The words (Chinese: characters) that sentences have and lists lack, from all documents.

    Stretches whose outer shape alone tells them are counted over the whole crawl: those that end like sentences and have
    next to no separators, and those full of separators or links that don't end so. A word is kept that stands in at least ``least_share``
    of the documents, and no fewer than three, and whose share of the first kind is at least ``times`` its share of the
    second; the ``VOCABULARY`` most frequent of them, so the model is bounded. Counts are made per batch before the
    shuffle. No word list is given: without any plain sentence nothing is known, and shapes are judged by their outlines."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        plain, listed, seen = Counter(), Counter(), Counter()
        for t in batch.column("text").to_pylist():
            own = set()
            for s in stretches(t or ""):
                sh, parts = shape(s)
                if sh.outline == "plain":
                    plain.update(parts)
                    own.update(parts)
                elif sh.outline == "listed":
                    listed.update(parts)
            seen.update(own)
        names = list(plain.keys() | listed.keys())
        if not names:
            return None
        return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([c[w] for w in names], pa.int64()) for c in (plain, listed, seen))], names=["unit", "n_plain", "n_listed", "n_docs"])

    counts = map_arrow(documents.where("text is not null").select("text"), run, "unit string, n_plain bigint, n_listed bigint, n_docs bigint")
    counts = table(counts.where(~F.col("unit").rlike("^[^\\p{L}]*$|[0-9]")).groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("n_plain", "n_listed", "n_docs"))), "units")
    han = F.col("unit").rlike("^[㐀-鿿]$")
    total = {r["han"]: r for r in counts.groupBy(han.alias("han")).agg(F.sum("n_plain").alias("p"), F.sum("n_listed").alias("l")).collect()}
    least = max(3.0, least_share * documents.count())
    share = lambda c, k, more: F.when(han, (F.col(c) + more) / max(1, total[True][k] if True in total else 1)).otherwise((F.col(c) + more) / max(1, total[False][k] if False in total else 1))
    rows = counts.where((F.col("n_docs") >= least) & (share("n_plain", "p", 0.0) >= times * share("n_listed", "l", 0.5 if total else 0.0))).orderBy(F.desc("n_plain"), "unit").limit(VOCABULARY).collect()
    return frozenset(r["unit"] for r in rows)


def page(text: str, known: frozenset[str]) -> tuple[int, int, int]:
    """Characters (spaces aside) in all stretches, in those that aren't sentences, and in the eight most common
    of the shapes that aren't sentences. Lone headings and names of up to four words between sentences count as text of
    their neighbours."""
    total, bad = 0, Counter()
    parts = [(s, shape(s, known)[0], len(s) - s.count(" ")) for s in stretches(text)]
    flags = [not sh.sentence for _, sh, _ in parts]
    for i, (s, sh, size) in enumerate(parts):
        total += size
        if flags[i]:
            alone = len(parts) > 1 and sh.links == 0 and sh.words <= 1 and sh.separators < 2 and not (i and flags[i - 1]) and not (i + 1 < len(parts) and flags[i + 1])
            if not alone:
                bad[sh] += size
    return total, sum(bad.values()), sum(n for _, n in bad.most_common(8))


def shares(documents: DataFrame, known: frozenset[str] | None = None) -> DataFrame:
    """(doc_id, n_chars_all, n_chars_listed, n_chars_top) per document whose text isn't null or blank: characters of
    the page, of its stretches that aren't sentences, and of its eight most common shapes of those."""
    known = learned(documents) if known is None else known
    shared = documents.sparkSession.sparkContext.broadcast(known)  # VOCABULARY words at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, rows = [], []
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if t is not None and not t.isspace() and t:
                ids.append(i)
                rows.append(page(t, shared.value))
        if not ids:
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", "n_chars_all", "n_chars_listed", "n_chars_top"])

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id bigint, n_chars_all bigint, n_chars_listed bigint, n_chars_top bigint")


def flagged(documents: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id) of the documents dominated by few shapes that aren't sentences: the eight most common of them have more
    than ``share`` of the characters. Null, empty and blank texts are never flagged; repeated rows are each judged alone."""
    return shares(documents).where(F.col("n_chars_top") > share * F.col("n_chars_all")).select("doc_id")


def shape_counts(documents: DataFrame) -> DataFrame:
    """(script, words, capitals, separators, links, ended, grammar, sentence, n_stretches, n_chars): the shapes of all
    stretches of all documents. Counted per batch before the shuffle; there are at most a few thousand shapes."""
    shared = documents.sparkSession.sparkContext.broadcast(learned(documents))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        count: Counter = Counter()
        size: Counter = Counter()
        for t in batch.column("text").to_pylist():
            for s in stretches(t or ""):
                sh, _ = shape(s, shared.value)
                count[sh] += 1
                size[sh] += len(s)
        if not count:
            return None
        shapes = list(count)
        columns = [pa.array([s.script for s in shapes]), *(pa.array([getattr(s, f) for s in shapes], pa.int32()) for f in ("words", "capitals", "separators", "links")), pa.array([s.ended for s in shapes]), pa.array([s.grammar for s in shapes], pa.int32()), pa.array([s.sentence for s in shapes])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([count[s] for s in shapes], pa.int64()), pa.array([size[s] for s in shapes], pa.int64())], names=[*Shape._fields, "sentence", "n_stretches", "n_chars"])

    each = map_arrow(documents.select("text"), run, "script string, words int, capitals int, separators int, links int, ended boolean, grammar int, sentence boolean, n_stretches bigint, n_chars bigint")
    return each.groupBy(*Shape._fields, "sentence").agg(F.sum("n_stretches").alias("n_stretches"), F.sum("n_chars").alias("n_chars"))
