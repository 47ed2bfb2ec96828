"""Lines and passages that one source repeats over many documents, found through content-defined chunks.

A body is cut into chunks where a rolling hash over its normal form says so, so the same passage gives the same chunks
wherever it stands; a line's end always ends a chunk. One table counts, for each chunk and source, the documents. A
line's last chunk is counted once more together with what leads to it on its line. So repeated lines are read off the
table, and what is cut from a body are lines and long runs of repeated chunks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spans import Spans, U, mix, pieces, run_starts
from millrace.llm.marks import marks_of
from millrace.session import cut
from millrace.sources.tables import one_of_each

#: Bytes that the rolling hash sees, and how many of its bits must be 0 for a cut: a chunk has about 2**BITS bytes.
WIDTH, BITS = 8, 5
#: Bytes of the normal form from which a run of repeated chunks is cut that is no whole line.
PASSAGE = 120

_blanks, _digits = re.compile(r"[^\S\n]+"), re.compile("[0-9]+")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and leading "www."; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normal_lines(text: str | None) -> list[str]:
    """The normal form of each line of a text cut at "\\n": lower case, one space for white space, "0" for digits."""
    return [x.strip() for x in _digits.sub("0", _blanks.sub(" ", text.lower())).split("\n")] if text else []


class _Lines:
    """The lines of a batch that aren't blank: row, line number, a key of source and normal form, and their chunks."""

    def __init__(self, batch: pa.RecordBatch):
        per = [normal_lines(x) for x in batch.column(2).to_pylist()]
        rows = np.repeat(np.arange(len(per)), [len(x) for x in per])
        flat = [x for p in per for x in p]
        number = np.arange(len(rows)) - np.repeat(np.cumsum([0, *map(len, per)])[:-1], [len(x) for x in per]) if per else rows
        keep = np.fromiter(map(bool, flat), bool, len(flat))
        source = Spans(batch.column(1))
        source = source.hash(source.at[:-1], source.at[1:])
        self.row, self.number = rows[keep], number[keep]
        spans = Spans(pa.array([x for x in flat if x], pa.large_string()))
        source = source[self.row] if len(self.row) else np.empty(0, U)
        start, end = spans.at[:-1], spans.at[1:]
        self.key = mix(spans.hash(start, end) ^ source)
        n = len(spans.bytes)
        ends = np.zeros(n, bool)
        if n:
            ends = (spans.window(WIDTH) >> U(64 - BITS)) == 0
            ends &= np.arange(n) - np.repeat(start, end - start) >= WIDTH - 1  # the hash starts anew on each line
            ends[end - 1] = True
        last = np.flatnonzero(ends)
        self.starts, self.ends = np.concatenate([[0], last[:-1] + 1])[: len(last)], last + 1
        self.of = np.searchsorted(spans.at, self.starts, "right") - 1
        self.first = run_starts(self.of)
        self.single = np.diff([*self.first, len(self.of)]) == 1
        # a chunk that is its whole line is known by the line's key
        self.chunk = mix(spans.hash(self.starts, self.ends) ^ mix(source[self.of])) if n else np.empty(0, U)
        self.chunk[self.first[self.single]] = self.key[self.single]
        self.starts, self.ends = self.starts - spans.at[self.of], self.ends - spans.at[self.of]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sources(df: DataFrame, key: str, source: Column, text: str) -> DataFrame:
    one = one_of_each(df.select(F.col(key).alias("key"), source.alias("source"), F.col(text).cast("string").alias("text")), "key")
    return one.filter("source is not null and text is not null").select("key", "source", "text")


def chunk_table(lines: DataFrame) -> DataFrame:
    """(chunk, documents) of (key, source, text): in how many texts of its source a chunk stands.

    chunk is a key of source and content; for a line's end, of source and whole line. Every batch makes its own sums, so
    only these are shuffled and a source with a third of all rows is no hot group.
    """

    def count(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                x = _Lines(part)
                long = ~x.single
                chunk, row = np.concatenate([x.chunk, x.key[long]]), np.concatenate([x.row[x.of], x.row[long]])
                order = np.lexsort((row, chunk))
                chunk, row = chunk[order], row[order]
                chunk = chunk[run_starts(chunk, row)]  # a document counts once
                at = run_starts(chunk)
                yield pa.RecordBatch.from_arrays([_signed(chunk[at]), pa.array(np.diff([*at, len(chunk)]), pa.int64())], ["chunk", "n"])

    return lines.mapInArrow(count, "chunk long, n long").groupBy("chunk").agg(F.sum("n").alias("documents"))


def find(df: DataFrame, key: str, source: Column, text: str, least: int = 10) -> DataFrame:
    """(key, line_no): the places of lines that at least `least` distinct keys of one source have, counted from 0.

    A line is repeated if the chunks that cover it are, the last one together with all before it. Chunks are looked up in
    a table of marks first, so only lines that may be repeated are joined with the table of chunks. Rows without key,
    source or text have none. Of rows with one key, one counts. Blank lines never count. An empty table gives an empty
    result.
    """
    lines = _sources(df, key, source, text)
    often = cut(chunk_table(lines).filter(F.col("documents") >= least).select("chunk"))
    marks = marks_of(often)
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("line_no", T.IntegerType()), T.StructField("chunk", T.LongType())])

    def places(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                x = _Lines(part)
                covered = np.minimum.reduceat(marks.value.hit(x.chunk), x.first) if len(x.first) else np.empty(0, bool)
                k = np.flatnonzero(covered & marks.value.hit(x.key))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(x.row[k])), pa.array(x.number[k], pa.int32()), _signed(x.key[k])], ["key", "line_no", "chunk"])

    return lines.mapInArrow(places, schema).join(often, "chunk", "left_semi").select(F.col("key").alias(key), "line_no")


def _places_of(line: str) -> list[int]:
    """Of each byte of a line's normal form, the character of the line that it comes from."""
    out: list[int] = []
    before = " "
    for k, c in enumerate(line):
        low = " " if c.isspace() else "0" if c in "0123456789" else c.lower()
        if not (low == before and low in " 0"):
            out += [k] * len(low.encode("utf-8", "surrogatepass"))
        before = low
    return out


def without(text: str, lines: set[int], parts: dict[int, list[tuple[int, int]]]) -> str:
    """A text without whole lines, and without parts of others, given in bytes of their normal forms."""
    out = []
    for k, line in enumerate(text.split("\n")):
        if k in lines:
            continue
        if k in parts:
            at, kept, done = _places_of(line), [], 0
            for a, b in parts[k]:
                kept.append(line[done : at[a] if a < len(at) else len(line)])
                done = at[b] if b < len(at) else len(line)
            line = "".join([*kept, line[done:]])
        out.append(line)
    return "\n".join(out)


def remove(df: DataFrame, key: str, source: Column, text: str, least: int = 10, passage: int = PASSAGE) -> DataFrame:
    """(key, text, removed): each distinct key's text without its repeated lines and passages, and how many these were.

    Repeated lines are those of find(). A passage is a run of neighbouring chunks, over the ends of lines too, that each
    stand in `least` texts of the source, on no repeated line, and are `passage` bytes long together; what is left of a
    line stays as it is.
    Texts without any come out as they are; a null text stays null. Rows with a null key are left out.
    """
    lines = _sources(df, key, source, text)
    often = cut(chunk_table(lines).filter(F.col("documents") >= least).select("chunk"))
    marks = marks_of(often)
    kind = T.StructField("key", df.schema[key].dataType)
    places = "line int, place int, start int, stop int, whole boolean, chunk long"

    def candidates(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                x = _Lines(part)
                hit = np.flatnonzero(marks.value.hit(x.chunk))
                ends = np.flatnonzero(marks.value.hit(x.key) & ~x.single)  # the whole line, where it has several chunks
                place = np.arange(len(x.of)) - np.repeat(run_starts(x.row[x.of]), np.diff([*run_starts(x.row[x.of]), len(x.of)])) if len(x.of) else x.of
                row = np.concatenate([x.row[x.of[hit]], x.row[ends]])
                columns = (np.concatenate([x.number[x.of[hit]], x.number[ends]]), np.concatenate([place[hit], ends * 0]), np.concatenate([x.starts[hit], ends * 0]), np.concatenate([x.ends[hit], ends * 0]))
                whole = np.concatenate([x.single[x.of[hit]], np.ones(len(ends), bool)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(c, pa.int32()) for c in columns), pa.array(whole), _signed(np.concatenate([x.chunk[hit], x.key[ends]]))], ["key", "line", "place", "start", "stop", "whole", "chunk"])

    found = lines.mapInArrow(candidates, T.StructType([kind, *T.StructType.fromDDL(places).fields])).join(often, "chunk", "left_semi")
    # the chunks of one text are no more than the text itself
    per = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("line", "place", "start", "stop", "whole"))).alias("found"))
    own = one_of_each(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "key")

    def clean(batches):
        for batch in batches:
            texts, counts = [], []
            for body, marked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone = {m["line"] for m in marked if m["whole"]}
                runs: list[list] = []
                for m in sorted((m for m in marked if m["line"] not in gone), key=lambda m: m["place"]):
                    if runs and m["place"] == runs[-1][-1]["place"] + 1:
                        runs[-1].append(m)
                    else:
                        runs.append([m])
                runs = [run for run in runs if sum(m["stop"] - m["start"] for m in run) >= passage]
                parts: dict[int, list[tuple[int, int]]] = {}
                for m in (m for run in runs for m in run):
                    own = parts.setdefault(m["line"], [])
                    if own and own[-1][1] == m["start"]:
                        own[-1] = (own[-1][0], m["stop"])
                    else:
                        own.append((m["start"], m["stop"]))
                texts.append(without(body, gone, parts))
                counts.append(len(gone) + len(runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], [key, "text", "removed"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())])
    touched = own.join(per, "key").select("key", "text", "found").mapInArrow(clean, schema)
    rest = own.join(per.select("key"), "key", "left_anti").select(F.col("key").alias(key), "text", F.lit(0).alias("removed"))
    return touched.unionByName(rest)
