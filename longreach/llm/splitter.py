"""Oversized texts cut into overlapping pieces at natural boundaries, without loading a whole text in one task.

1. A text is divided into ranges; each range travels alone, with a halo on its right: a full stop is a boundary only if
   white space follows, and a line feed may complete ``\\r\\n``. Files are read range by range; a table's cell is cut
   into ranges in one pass by the task that reads it.
2. Workers list the natural boundaries of their range and the bytes before each: a boundary table. Where characters have
   different widths, it has the places at which the width changes, not the widths.
3. Summaries of the tables (about 50 bytes a range) tell whether a text has a stretch above the limit.
4. The tables of a text are stitched in order: lengths are summed, so each boundary gets its absolute offsets in
   characters and bytes, and pieces are emitted as they fill. A worker streams over sorted tables and holds the tables
   that the open piece reaches into; neither a text nor its pieces are gathered.
5. Pieces are offsets; their texts are cut out of the record where wanted (``with_text``).

Natural boundaries: line ends, after 。 ！ ？, and after . ! ? followed by white space.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import table
from .text import code_points, map_arrow

RANGE = 16_384
_BOUNDARY = re.compile(r"\r\n|[\n\r]|[。！？]|[.!?](?=\s)")


class Widths(NamedTuple):
    """Runs of characters of the same width: where each begins, in characters and bytes of the range, and its width."""

    chars: np.ndarray
    bytes: np.ndarray
    width: np.ndarray

    def at(self, byte: int, up: bool) -> tuple[int, int]:
        """Character and byte offset of the nearest character boundary at or after (``up``) or at or before a byte."""
        k = int(np.searchsorted(self.bytes, byte, "right")) - 1
        n, rest = divmod(byte - int(self.bytes[k]), int(self.width[k]))
        n += up and rest > 0
        return int(self.chars[k]) + n, int(self.bytes[k]) + n * int(self.width[k])


def width_runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the width of the characters changes (0 first), and the widths."""
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    begin = np.flatnonzero(np.diff(width, prepend=-1))
    return begin.astype(np.int32), width[begin].astype(np.int32)


def widths_of(begin: np.ndarray, width: np.ndarray) -> Widths:
    return Widths(begin, np.concatenate([[0], np.cumsum(np.diff(begin) * width[:-1])]), width)


def boundary_table(part: str, after: str) -> tuple[np.ndarray, np.ndarray, int, int, np.ndarray, np.ndarray]:
    """Characters and bytes before each boundary of a range, its length in both, and its width runs. ``after`` is the
    character behind the range."""
    points, _ = code_points([part])
    begin, width = width_runs(points)
    runs = widths_of(begin, width)
    ends = np.array([m.end() for m in _BOUNDARY.finditer(part + after) if m.end() <= len(part)], np.int64)  # the next range has the halo's
    inside = lambda c: runs.bytes[k := np.searchsorted(begin, c, "right") - 1] + (c - begin[k]) * width[k]
    size = int(inside(np.int64(len(part)))) if len(part) else 0
    return ends, inside(ends) if len(ends) else ends, len(part), size, begin, width


class Piece(NamedTuple):
    number: int
    start: int  # characters
    end: int
    n_bytes: int
    forced: bool  # a stretch between neighbouring boundaries is above the limit by itself


def stitch(tables: Iterable[tuple[list[int], list[int], int, int, Widths]], limit: int, overlap: int) -> Iterator[Piece]:
    """Pieces of at most ``limit`` bytes from the boundary tables of one text, in order.

    A piece ends at the last natural boundary within the limit. Where a stretch is above the limit by itself, the piece
    ends inside it, at the last character that fits. The next piece starts ``overlap`` bytes before that end, at the
    first character there."""
    number, start_c, start_b = 0, 0, 0
    done_c = done_b = 0  # end of the last piece
    off_c = off_b = 0  # start of the current range
    last = (0, 0)  # last boundary seen
    widths: deque[tuple[int, int, int, Widths]] = deque()  # ranges that a start or a cut may fall into
    waiting: tuple[int, int] | None = None  # last boundary that fits into the piece

    def character_at(byte: int, up: bool) -> tuple[int, int]:
        """The nearest character boundary at or after (``up``) or at or before a byte offset."""
        for c0, b0, size, table in widths:
            if byte <= b0 + size:
                c, b = table.at(byte - b0, up)
                return c0 + c, b0 + b
        raise AssertionError("offset beyond what was read")

    def emit(end: tuple[int, int], by_force: bool) -> Piece:
        nonlocal number, start_c, start_b, done_c, done_b, waiting
        piece = Piece(number, start_c, end[0], end[1] - start_b, by_force)
        number += 1
        done_c, done_b = end
        start_c, start_b = character_at(max(start_b + 1, end[1] - overlap), True)
        if start_b > done_b:
            start_c, start_b = end
        waiting = None
        return piece

    def advance(boundary: tuple[int, int]) -> Iterator[Piece]:
        nonlocal waiting, last, start_c, start_b
        inside = boundary[1] - last[1] > limit
        while boundary[1] - start_b > limit:
            if waiting is not None and waiting[1] > done_b:
                yield emit(waiting, False)
            elif inside:
                yield emit(character_at(start_b + limit, False), True)
            else:  # the stretch fits a piece, but not behind the whole overlap: the overlap gives way
                start_c, start_b = character_at(boundary[1] - limit, True)
        waiting = boundary
        last = boundary

    for ends_c, ends_b, chars, size, table in tables:
        widths.append((off_c, off_b, size, table))
        for c, b in zip(ends_c, ends_b):
            yield from advance((off_c + c, off_b + b))
        off_c, off_b = off_c + chars, off_b + size
        while len(widths) > 1 and widths[0][1] + widths[0][2] < start_b - 4:
            widths.popleft()
    if off_b > last[1]:
        yield from advance((off_c, off_b))
    if off_b > done_b:
        yield emit((off_c, off_b), False)


_TABLES = "rec bigint, rate double, part int, ends_c array<int>, ends_b array<int>, chars int, bytes int, run_c array<int>, run_w array<int>"
_INTS = pa.list_(pa.int32())
_TYPES = (pa.int64(), pa.float64(), pa.int32(), _INTS, _INTS, pa.int32(), pa.int32(), _INTS, _INTS)


def _table_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _TABLES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(_TYPES)], names=names)


def pieces(records: DataFrame, limit_tokens: int, overlap_tokens: int, range_chars: int = RANGE) -> DataFrame:
    """(rec, piece, start, end, n_bytes, forced) of the records whose token size is above ``limit_tokens``.

    ``records`` has (rec, text, rate), rec unique; other columns are ignored. ``start`` and ``end`` are offsets in
    characters (end exclusive). ``forced`` is true for all pieces of a record with a stretch between neighbouring
    natural boundaries that is above the limit by itself. Rows with a null in any of the three have no pieces. Offsets
    refer to the text as it is, white space included."""
    size = F.octet_length("text")
    over = records.where("rec is not null and rate > 0").where(F.ceil(F.round(size * F.col("rate"), 9)) > limit_tokens)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges with a halo of one character; each cell is passed over once, and a batch has about 64 ranges."""
        out: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                rec, rate, text = (batch.column(c)[i].as_py() for c in ("rec", "rate", "text"))
                for part, start in enumerate(range(0, len(text), range_chars)):
                    out.append((rec, rate, part, text[start : start + range_chars], text[start + range_chars : start + range_chars + 1]))
                    if len(out) == 64:
                        yield ranges_of(out)
                        out = []
        if out:
            yield ranges_of(out)

    def ranges_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.float64(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["rec", "rate", "part", "text", "halo"])

    def detect(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _table_batch([(rec, rate, k, *boundary_table(t, halo)) for rec, rate, k, t, halo in zip(*(batch.column(c).to_pylist() for c in ("rec", "rate", "part", "text", "halo")))])

    ranges = over.select("rec", "rate", "text").mapInArrow(cut, "rec bigint, rate double, part int, text string, halo string")
    return _stitched(map_arrow(ranges.repartition("rec", "part"), detect, _TABLES), limit_tokens, overlap_tokens)


def file_pieces(spark: SparkSession, paths: list[str], rate: float, limit_tokens: int, overlap_tokens: int, range_bytes: int = 8 << 20) -> DataFrame:
    """(rec, piece, start, end, n_bytes, forced) of UTF-8 files, ``rec`` their place in ``paths``; files within the limit
    come as one piece, empty ones as none.

    A task reads one range of bytes and a halo of eight: characters belong to the range that holds their first byte, so
    no file is ever read whole. Paths must be visible to all executors (any file system that Arrow knows)."""
    from pyarrow import fs

    def opened(path: str):
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    plan = []
    for rec, path in enumerate(paths):
        store, local = opened(path)
        size = store.get_file_info(local).size
        plan += [(rec, part, path, start, min(size, start + range_bytes)) for part, start in enumerate(range(0, size, range_bytes))]
    ranges = spark.createDataFrame(plan, "rec bigint, part int, path string, start bigint, end bigint").repartition(max(1, min(len(plan), 10_000)), "rec", "part")

    def detect(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for rec, part, path, start, end in zip(*(batch.column(c).to_pylist() for c in ("rec", "part", "path", "start", "end"))):
            store, local = opened(path)
            with store.open_input_file(local) as f:
                f.seek(start)
                raw = f.read(end - start + 8)
            skip = 0
            while start and skip < len(raw) and raw[skip] & 0xC0 == 0x80:
                skip += 1  # the range before has this character
            stop = end - start
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                stop += 1
            rows.append((rec, rate, part, *boundary_table(raw[skip:stop].decode(), raw[stop : stop + 4].decode(errors="ignore")[:1])))
        return _table_batch(rows)

    return _stitched(map_arrow(ranges, detect, _TABLES), limit_tokens, overlap_tokens)


def _forced(tables: DataFrame, limit: Column) -> DataFrame:
    """(rec, forced): whether some stretch between neighbouring boundaries is above the limit. A range is summed up by its
    bytes, those before its first and after its last boundary, and the longest stretch between; the summaries of a text,
    in order, give its longest stretch."""
    ends = F.col("ends_b")
    longest = F.array_max(F.transform(ends, lambda e, i: e - F.when(i > 0, F.get("ends_b", i - 1)).otherwise(e)))
    summary = F.struct("part", F.get(ends, F.lit(0)).alias("head"), F.coalesce(longest, F.lit(0)).alias("inside"), (F.col("bytes") - F.element_at(ends, -1)).alias("tail"), "bytes")
    row = tables.select("rec", limit.alias("_limit"), F.when(F.size(ends) > 0, summary).otherwise(F.struct("part", F.lit(None).cast("int").alias("head"), F.lit(0).alias("inside"), F.lit(None).cast("int").alias("tail"), "bytes")).alias("s"))
    big = lambda x: x.cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("open"), F.lit(0).cast("bigint").alias("most"))

    def step(acc: Column, s: Column) -> Column:
        joined = acc["open"] + big(F.coalesce(s["head"], s["bytes"]))
        return F.struct(F.when(s["head"].isNull(), joined).otherwise(big(s["tail"])).alias("open"), F.greatest(acc["most"], joined, big(s["inside"])).alias("most"))

    folded = row.groupBy("rec").agg(F.first("_limit").alias("_limit"), F.array_sort(F.collect_list("s")).alias("s"))
    return folded.select("rec", (F.aggregate("s", start, step, lambda acc: F.greatest(acc["most"], acc["open"])) > F.col("_limit")).alias("forced"))


def _stitched(tables: DataFrame, limit_tokens: int, overlap_tokens: int) -> DataFrame:
    """Pieces from boundary tables: each text's tables go through one task in order, which holds one piece at a time."""
    tables = table(tables, "tables")
    told = tables.join(_forced(tables, F.floor(F.lit(limit_tokens) / F.col("rate") + 1e-9)), "rec")
    sorted_tables = told.repartition("rec").sortWithinPartitions("rec", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                lists = [[np.asarray(x.values) for x in batch.column(c)] for c in ("ends_c", "ends_b", "run_c", "run_w")]
                yield from zip(*(batch.column(c).to_pylist() for c in ("rec", "rate", "forced", "chars", "bytes")), *lists)

        out: list[tuple] = []
        for (rec, rate, forced), group in groupby(rows(), key=lambda r: r[:3]):
            limit, overlap = int(limit_tokens / rate + 1e-9), int(overlap_tokens / rate + 1e-9)
            for p in stitch(((ec.tolist(), eb.tolist(), chars, n, widths_of(rc, rw)) for _, _, _, chars, n, ec, eb, rc, rw in group), limit, overlap):
                out.append((rec, p.number, p.start, p.end, p.n_bytes, forced))
                if len(out) == 8192:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return sorted_tables.mapInArrow(run, "rec bigint, piece int, start bigint, end bigint, n_bytes bigint, forced boolean")


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["rec", "piece", "start", "end", "n_bytes", "forced"])


def with_text(found: DataFrame, records: DataFrame) -> DataFrame:
    """Adds to pieces their text, cut out of ``records`` (rec, text)."""
    return found.join(records.select("rec", "text"), "rec").withColumn("text", F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))


def breaches(found: DataFrame, records: DataFrame, limit_tokens: int, overlap_tokens: int) -> DataFrame:
    """(rule, rec): where pieces break the rules of splitting; empty for right ones. ``over``: a piece above the limit;
    ``gap``: one that doesn't begin within the piece before it, or doesn't go beyond it; ``overlap``: a longer overlap than
    asked for; ``ends``: pieces that don't cover the text; ``unnatural``: a piece of a text without forced cuts that ends
    elsewhere than at a natural boundary; ``missing``: a text above the limit without pieces."""
    byte_limit = F.floor(F.lit(limit_tokens) / F.col("rate") + 1e-9)
    texts = records.where("rec is not null and rate > 0").where(F.ceil(F.round(F.octet_length("text") * F.col("rate"), 9)) > limit_tokens)
    w = Window.partitionBy("rec").orderBy("piece")
    part = lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))
    rows = found.withColumns({"_before": F.lag("end").over(w), "_next": F.lead("end").over(w)}).join(texts.select("rec", "text", "rate"), "rec", "right")
    last = F.col("_next").isNull()
    tail = part(F.col("end") - 1, F.col("end") + 1)
    natural = tail.rlike(r"^[\n\r。！？]|^[.!?]\s") & ~((F.substring(tail, 1, 1) == "\r") & (F.substring(tail, 2, 1) == "\n"))
    rule = (
        F.when(F.col("piece").isNull(), "missing")
        .when((F.col("n_bytes") > byte_limit) | (F.octet_length(part(F.col("start"), F.col("end"))) != F.col("n_bytes")), "over")
        .when((F.col("_before") < F.col("start")) | (F.col("end") <= F.col("_before")), "gap")
        .when(F.octet_length(part(F.col("start"), F.col("_before"))) > F.floor(F.lit(overlap_tokens) / F.col("rate") + 1e-9), "overlap")
        .when((F.col("_before").isNull() & (F.col("start") != 0)) | (last & (F.col("end") != F.length("text"))), "ends")
        .when(~F.col("forced") & ~last & ~natural, "unnatural")
    )
    return rows.select(rule.alias("rule"), "rec").where("rule is not null")
