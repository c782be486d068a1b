"""Evaluation items that stand in corpus documents, wholly or partly.

1. Texts are reduced to letters and digits in lower case. Items are cut into windows at every offset, documents into
   windows side by side, half as long as the run looked for: any shared run then holds a whole window of the document.
2. Each window is embedded by CGK random walks (Chakraborty, Goldenberg, Koucky 2016): a walk reads a character, writes it,
   and steps on or not by a random function of step and character, so that windows at a small edit distance give strings
   at a small Hamming distance. Of each walk a few positions are sampled as a key; ``repeats`` walks with samples of their
   own reach the target recall for windows within ``edits`` edits.
3. The keys of items and documents are tables and meet in a join, in parts where a key is hot. A bit table of the items'
   keys, of a fixed size, keeps document windows out of the shuffle that no item can meet; it loses none.
4. Windows that share a key, for their first one in common, are verified on the stretches around them: by the edit distance
   of item-sized stretches, and with ``exact`` also by the length of the shared run.

Nothing of items or documents is held by the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import salted_join, table
from .text import code_points, map_arrow

FILTER_BITS = 25  # the bit table has 2 to that power: 4 MB
SAMPLED = 8  # positions of a walk in a key
_OTHER = re.compile(r"[\W_]+")


def reduced(text: str) -> str:
    return _OTHER.sub("", text.lower())


def repeats_for(edits: float, window: int, recall: float) -> int:
    """Walks needed so that a window within ``edits`` edits shares a key with probability ``recall``: per edit, a walk
    differs in about 2 positions before it falls into step again, and a sample must miss all of them."""
    if edits == 0:
        return 1
    differing = min(0.9, edits * 6.0 / (3 * window))
    hit = (1 - differing) ** SAMPLED
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


@lru_cache(64)
def _walk(window: int, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers of the random step function for each step, and the sampled steps."""
    rng = np.random.default_rng((window, repeat, 2016))
    steps = rng.integers(1, 2**31, 3 * window, dtype=np.int64).astype(np.uint32) << np.uint32(1) | np.uint32(1)
    return steps, np.sort(rng.choice(2 * window, min(SAMPLED, 2 * window), replace=False))


def cgk_keys(points: np.ndarray, starts: np.ndarray, window: int, repeat: int) -> np.ndarray:
    """The sampled key (64 bits) of the CGK walk over each window of ``points``."""
    steps, sampled = _walk(window, repeat)
    at = starts.copy()
    end = starts + window
    key = np.full(len(starts), np.uint64(repeat * 0x9E3779B1 + window), np.uint64)
    wanted = set(sampled.tolist())
    padded = np.append(points, np.zeros(1, np.uint32))
    for j in range(int(sampled[-1]) + 1):
        inside = at < end
        seen = padded[np.minimum(at, len(points))]
        seen[~inside] = 0
        if j in wanted:
            key ^= seen
            key *= np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        mixed = seen * steps[j]
        mixed ^= mixed >> np.uint32(15)
        at += ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(31)) & inside
    return key


class Search(NamedTuple):
    """What is looked for in one language."""

    lang: str
    run: int
    edits: int
    repeats: int

    @property
    def window(self) -> int:
        return max(1, (self.run + 1) // 2)


def window_keys(texts: list[str], search: Search, step: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and offset of each window, ``step`` characters apart, and its keys (repeats x windows). ``wide``: only
    windows with a character beyond ASCII."""
    w = search.window
    points, lengths = code_points(texts)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    count = np.maximum(0, (lengths - w) // step + 1)
    which = np.repeat(np.arange(len(texts)), count)
    offset = (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * step
    starts = begin[which] + offset
    if wide:
        beyond = np.concatenate([[0], np.cumsum(points > 127)])
        keep = beyond[starts + w] > beyond[starts]
        which, offset, starts = which[keep], offset[keep], starts[keep]
    return which, offset, np.stack([cgk_keys(points, starts, w, r) for r in range(search.repeats)]).view(np.int64)


def shared_run(doc: str, item: str, d: int, i: int, window: int) -> int:
    """Length of the longest shared run that holds the aligned windows at d and i."""
    left = 0
    while d - left > 0 and i - left > 0 and doc[d - left - 1] == item[i - left - 1]:
        left += 1
    right = window
    while d + right < len(doc) and i + right < len(item) and doc[d + right] == item[i + right]:
        right += 1
    return left + right


def furthest(a: str, b: str, most: int) -> list[int]:
    """For 0..most edits, the length of the longest prefix of ``a`` that turns into some prefix of ``b``; by furthest
    points on diagonals."""
    n, m = len(a), len(b)
    reached: dict[int, int] = {0: 0}
    out = []
    for e in range(most + 1):
        if e:
            new: dict[int, int] = {}
            for k in range(-e, e + 1):
                i = max(reached.get(k, -2) + 1, reached.get(k + 1, -2) + 1, reached.get(k - 1, -2))
                i = min(i, n, m - k)
                if i >= 0 and i + k >= 0:
                    new[k] = i
            reached = new
        for k, i in reached.items():
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            reached[k] = i
        out.append(max(reached.values()))
        if out[-1] == n:
            return out + [n] * (most - e)
    return out


def within_edits(doc: str, item: str, d: int, i: int, run: int, most: int) -> bool:
    """Whether some stretch of ``run`` characters of the item around place i, with place i facing place d of the
    document, turns into text of the document by at most ``most`` edits."""
    right = furthest(item[i : i + run], doc[d : d + run + most], most)
    left = furthest(item[max(0, i - run) : i][::-1], doc[max(0, d - run - most) : d][::-1], most)
    return any(left[e] + right[most - e] >= run for e in range(most + 1))


_WINDOWS = "lang string, key bigint, rep int, owner bigint, at int, stretch string, keys array<bigint>"


def _windows(rows: list[tuple], search: Search) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
    return pa.RecordBatch.from_arrays([pa.array([search.lang] * len(rows)), *columns], names=[f.split()[0] for f in _WINDOWS.split(", ")])


def _batches(ids: list[int], texts: list[str], most: int = 400_000) -> Iterator[tuple[list[int], list[str]]]:
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield ids[start:end], texts[start:end]
        start = end


def _bits(keys: DataFrame) -> np.ndarray:
    """The bit table of all keys: bit k is set where some key has k as its upper FILTER_BITS bits. Combined before the
    shuffle; what comes to the driver is bounded by the table's size."""
    upper = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    words = keys.groupBy(F.shiftright(upper, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(upper, F.lit(64)).cast("int"))).alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("b"))
    return out.view(np.uint64)


def leaks(documents: DataFrame, items: DataFrame, runs: dict[str, int], edits: float = 0.0, recall: float = 0.95, exact: bool = False) -> DataFrame:
    """(doc_id, item_id), each once, of the documents that share with the passage or the question of an item a stretch of
    ``runs[lang of the item]`` letters and digits within ``edits`` times its length in edits, one at least. With ``exact``,
    the stretch must be the same in both; the walks are those for the edits, and windows that are the same share all keys.

    ``documents`` has (doc_id, text), ``items`` (item_id, lang, passage, question); other columns are ignored. Null
    and short texts match nothing; items of a language without a run are left out; repeated rows count once. A
    document of any length is read whole."""
    searches = []
    for lang, run in sorted(runs.items()):
        most = max(1, int(edits * run))
        # a window is half a stretch: three quarters of the edits are more than what falls into most of them
        searches.append(Search(lang, run, most, repeats_for(max(1.0, most * 0.75), max(1, (run + 1) // 2), recall)))

    def reduce_items(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("lang"), pa.array([reduced(t) for t in batch.column("text").to_pylist()])], names=["item_id", "lang", "text"])

    rows = items.where(F.col("lang").isin(*runs) & F.col("item_id").isNotNull()).select("item_id", "lang", F.explode(F.array("passage", "question")).alias("text")).where("text is not null")
    owners = table(map_arrow(rows, reduce_items, "item_id bigint, lang string, text string").distinct().withColumn("owner", F.xxhash64("lang", "text")), "owners")

    def item_windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for search in searches:
            use = [(o, t) for o, la, t in zip(*(batch.column(c).to_pylist() for c in ("owner", "lang", "text"))) if la == search.lang and len(t) >= search.run]
            for ids, texts in _batches([o for o, _ in use], [t for _, t in use], 50_000):
                which, offset, keys = window_keys(texts, search, 1, False)
                stretch = [texts[k][max(0, i - search.run) : i + search.run] for k, i in zip(which.tolist(), offset.tolist())]
                own = keys.T.tolist()
                for r in range(search.repeats):
                    yield _windows([(k[r], r, ids[j], min(i, search.run), st, k) for k, j, i, st in zip(own, which.tolist(), offset.tolist(), stretch)], search)

    flat = owners.select("owner", "lang", "text").distinct()
    places = table(flat.mapInArrow(lambda batches: (b for batch in batches if batch.num_rows for b in item_windows(batch)), _WINDOWS), "places")
    bits = _bits(places.select("key"))
    # whether a language has windows of ASCII only; without, those of documents needn't be looked at
    plain = {r["lang"] for r in places.where(F.col("stretch").rlike("[\\x00-\\x7f]{%d}" % min(s.window for s in searches))).select("lang").distinct().collect()} if searches else set()
    shared = documents.sparkSession.sparkContext.broadcast(bits)  # 2^FILTER_BITS bits

    def document_windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = [(d, reduced(t)) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t is not None and d is not None]
        for search in searches:
            wide = search.lang not in plain
            w, reach = search.window, search.run + search.edits
            use = [(d, t) for d, t in every if len(t) >= w and not (wide and t.isascii())]
            for ids, texts in _batches([d for d, _ in use], [t for _, t in use]):
                which, offset, keys = window_keys(texts, search, w, wide)
                upper = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                rep, at = np.nonzero(shared.value[(upper >> np.uint64(6)).astype(np.int64)] >> (upper & np.uint64(63)) & np.uint64(1))
                if len(at):
                    out = []
                    for r, a in zip(rep.tolist(), at.tolist()):
                        k, d = which[a], int(offset[a])
                        out.append((int(keys[r, a]), r, ids[k], min(d, reach), texts[k][max(0, d - reach) : d + reach], keys[: r + 1, a].tolist()))
                    yield _windows(out, search)

    hits = documents.select("doc_id", "text").mapInArrow(lambda batches: (b for batch in batches if batch.num_rows for b in document_windows(batch)), _WINDOWS)
    hits = table(hits, "hits").select("lang", "key", "rep", F.col("owner").alias("doc_id"), F.col("at").alias("d"), F.col("stretch").alias("doc"), F.col("keys").alias("doc_keys"))
    met = ["lang", "rep", "key"]
    counts = hits.groupBy(*met).agg(F.count(F.lit(1)).alias("_n"))
    wanted = table(places.select(*met, "owner", F.col("at").alias("i"), F.col("stretch").alias("item"), F.col("keys").alias("item_keys")).join(counts, met), "wanted")
    by_lang = {s.lang: s for s in searches}

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found: set[tuple[int, int]] = set()
        columns = ("lang", "rep", "doc_id", "owner", "d", "i", "doc", "item", "doc_keys", "item_keys")
        for lang, rep, doc_id, owner, d, i, doc, item, dk, ik in zip(*(batch.column(c).to_pylist() for c in columns)):
            search = by_lang[lang]
            if (doc_id, owner) in found or exact and doc[d : d + search.window] != item[i : i + search.window]:
                continue
            if any(map(int.__eq__, dk[:rep], ik)):
                continue  # verified at an earlier walk
            if exact and shared_run(doc, item, d, i, search.window) < search.run:
                continue
            if within_edits(doc, item, d, i, search.run, search.edits):
                found.add((doc_id, owner))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["doc_id", "owner"]) if found else None

    pairs = salted_join(hits, wanted, met, ["doc_id", "d"], "_n").select("lang", "rep", "doc_id", "owner", "d", "i", "doc", "item", "doc_keys", "item_keys")
    verified = table(map_arrow(pairs, verify, "doc_id bigint, owner bigint").distinct(), "verified")
    sized = owners.join(verified.groupBy("owner").agg(F.count(F.lit(1)).alias("_n")), "owner").select("owner", "item_id", "_n")
    return salted_join(verified, table(sized, "sized"), ["owner"], ["doc_id"], "_n").select("doc_id", "item_id").distinct()
