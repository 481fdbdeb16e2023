"""Records of large JSON documents, read by many tasks.

A document is a list of records, or an object with the list under a key. The text reader deals byte
ranges of a document to tasks when lines end at closing braces. What a range means depends on what
stands before it: whether it begins inside a string, how deep, and in the list or not. So it
is read twice. The first reading sums each range up for either case (inside a string or not): how much deeper
it ends, and what opened last at each depth. Ranges are few; prefix sums over them
tell each one how it begins. In the second reading every task cuts its own records out, and hands
over the ends of those that reach into other ranges, which are put together.

A document whose brackets or strings don't close, or one of whose records isn't JSON, holds none.
Elements of the list that aren't objects are no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faturalens.plans.shared import written

ESCAPE = re.compile(rb"\\.", re.DOTALL)
BLANK = b" \t\r\n\xef\xbb\xbf"
LIST, OBJECT, END_OBJECT, END_LIST, QUOTE = map(ord, '[{}]"')
# Up to so many ranges (some 100 bytes each) are sent to every task; more are joined by a shuffle.
MOST_SENT = 200_000
SUMMARY = (
    "file string, start long, size long, quoted boolean, ends_quoted boolean, rise long, bytes long, mark string, "
    "opened array<struct<depth:long,object:boolean,wanted:boolean>>"
)
FOUND = "file string, start long, place long, kind string, text string"
# A record in one range, and the parts of one in several: its beginning, its end, what is between.
WHOLE, TAIL, HEAD, BETWEEN = "whole", "tail", "head", "between"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, size, value): the documents cut at closing braces, in the order of each byte range."""
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"), "value")


class Reading:
    """The brackets of some bytes of a document, given whether they begin inside a string and at which depth."""

    def __init__(self, text: bytes, quoted: bool, depth: int, key: bytes):
        if b"\\" in text:
            # Escaped characters are neither quotes nor brackets; places stay what they are.
            text = ESCAPE.sub(lambda m: b"." * len(m[0]), text)
        data = np.frombuffer(text, dtype=np.uint8)
        inside = (np.cumsum(data == QUOTE) + quoted) % 2 == 1
        opens = ((data == OBJECT) | (data == LIST)) & ~inside
        closes = ((data == END_OBJECT) | (data == END_LIST)) & ~inside
        self.at = np.flatnonzero(opens | closes)
        self.open, self.kind = opens[self.at], data[self.at]
        steps = np.where(self.open, 1, -1)
        self.after = depth + np.cumsum(steps)
        self.before = self.after - steps
        self.depth = int(self.after[-1]) if len(self.at) else depth
        self.quoted = bool(inside[-1]) if len(data) else quoted
        # Lists that the key opens, as in `"key" : [`; inside of strings its quotes would be escaped.
        marks = [m.end() - 1 for m in re.finditer(rb'"' + re.escape(key) + rb'"\s*:\s*\[', text)]
        self.wanted = np.isin(self.at, marks) & self.open


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes, bool]]:
    """(columns of the range, text, whether it is its last): ranges batch by batch, with their braces put back."""
    held: tuple[dict, bytes] | None = None
    for batch in batches:
        values = batch.column("value").cast(pa.binary()).to_pylist()
        keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))
        borders = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for low, high in zip(borders, borders[1:], strict=False):
            own = batch.slice(low, 1).drop_columns(["value"]).to_pylist()[0]
            if held is not None:
                yield *held, (own["file"], own["start"]) != (held[0]["file"], held[0]["start"])
            held = own, b"}".join(values[low:high]) + b"}"
    if held is not None:
        yield *held, True


def summaries(rows: DataFrame, key: str) -> DataFrame:
    """For either way that a range may begin: its rise in depth, how it ends, and what opened last at each depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[dict] = []
        for own, text, last in ranges(batches):
            if not states:
                mark = text.lstrip(BLANK)[:1].decode("ascii", "replace")
                states = [{**own, "quoted": q, "ends_quoted": q, "rise": 0, "bytes": 0, "mark": mark, "opened": {}} for q in (False, True)]
            for state in states:
                seen = Reading(text, state["ends_quoted"], state["rise"], key.encode())
                for depth, kind, wanted in zip(seen.before[seen.open].tolist(), seen.kind[seen.open].tolist(), seen.wanted[seen.open].tolist(), strict=True):
                    state["opened"][depth] = {"depth": depth, "object": kind == OBJECT, "wanted": wanted}
                state["ends_quoted"], state["rise"] = seen.quoted, seen.depth
                state["bytes"] += len(text)
            if last:
                done = [{**state, "opened": list(state["opened"].values())} for state in states]
                yield pa.RecordBatch.from_pylist(done, schema)
                states = []

    opened = pa.list_(pa.struct([("depth", pa.int64()), ("object", pa.bool_()), ("wanted", pa.bool_())]))
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [part.split() for part in SUMMARY.split(", ")]
    schema = pa.schema([(name, kinds.get(kind, opened)) for name, kind in fields])
    return rows.mapInArrow(run, SUMMARY)


def beginnings(summary: DataFrame) -> DataFrame:
    """(file, start, quoted, depth, level, listed, inside): how each range of a sound document begins.

    `level` is the depth at which records stand: 1 in a list, 2 in an object. `listed` says that the list
    open at depth 1 is the wanted one, `inside` that a record is open.
    """
    whole = Window.partitionBy("file")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # With an odd number of quotes a range ends on the other side of one than it began.
    odd = summary.where("NOT quoted").select(
        "file", "start", (F.coalesce(F.sum(F.col("ends_quoted").cast("int")).over(before), F.lit(0)) % 2 == 1).alias("quoted")
    )
    own = summary.join(odd, ["file", "start", "quoted"])

    def last_opened(depth: Column, field: str) -> Column:
        return F.get(F.filter("opened", lambda x: x["depth"] + F.col("depth") == depth), F.lit(0))[field]

    deep = own.select(
        "*",
        F.coalesce(F.sum("rise").over(before), F.lit(0)).alias("depth"),
        F.sum("rise").over(whole).alias("end"),
        F.sum("bytes").over(whole).alias("read"),
        F.max_by("ends_quoted", "start").over(whole).alias("cut_off"),
        F.min_by("mark", "start").over(whole).alias("first"),
    ).withColumn("level", F.when(F.col("first") == "[", 1).when(F.col("first") == "{", 2))
    known = deep.select(
        "*",
        F.last(last_opened(F.lit(1), "wanted"), ignorenulls=True).over(before).alias("wanted"),
        F.last(last_opened(F.col("level"), "object"), ignorenulls=True).over(before).alias("object"),
    )
    # Behind a document's last byte a brace was put that isn't there, unless it ends with one. Of a compressed
    # document the bytes can't be compared.
    closed = F.when(F.col("read") == F.col("size"), F.col("end") == 0).when(F.col("read") == F.col("size") + 1, F.col("end") == -1)
    sound = F.coalesce(closed, F.col("end").isin(0, -1)) & ~F.col("cut_off") & F.col("level").isNotNull()
    listed = (F.col("level") == 1) | F.coalesce("wanted", F.lit(False))
    inside = listed & (F.col("depth") > F.col("level")) & F.coalesce("object", F.lit(False))
    return known.where(sound).select("file", "start", "quoted", "depth", "level", listed.alias("listed"), inside.alias("inside"))


def advance(state: dict, text: bytes, key: bytes, out: list[tuple[str, bytes]]) -> None:
    """Take in the next bytes of a range: what ends goes to `out`, an open record stays in the state."""
    level = state["level"]
    seen = Reading(text, state["quoted"], state["depth"], key)
    listed = np.ones(len(seen.at), dtype=bool)
    if level == 2:
        # What stands at depth 2 belongs to what opened last at depth 1.
        turns = np.flatnonzero(seen.open & (seen.before == 1))
        which = np.searchsorted(turns, np.arange(len(seen.at)), side="right")
        said = np.concatenate([[state["listed"]], seen.wanted[turns]])
        listed, state["listed"] = said[which], bool(said[-1])
    begins = seen.open & (seen.kind == OBJECT) & (seen.before == level) & listed
    ends = (seen.kind == END_OBJECT) & (seen.after == level)
    low = 0
    for place, is_begin in zip(seen.at[begins | ends].tolist(), begins[begins | ends].tolist(), strict=True):
        if is_begin:
            low, state["open"], state["carried"] = place, bytearray(), False
        elif state["open"] is not None:
            out.append((HEAD if state["carried"] else WHOLE, bytes(state["open"]) + text[low : place + 1]))
            state["open"] = None
    if state["open"] is not None:
        state["open"] += text[low:]
    state["quoted"], state["depth"] = seen.quoted, seen.depth


def cut(rows: DataFrame, key: str) -> DataFrame:
    """Records that lie in one range, and the parts of those that don't, numbered in the order of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for own, text, last in ranges(batches):
            state = state or {**own, "open": bytearray() if own["inside"] else None, "carried": own["inside"], "place": 0}
            out: list[tuple[str, bytes]] = []
            advance(state, text, key.encode(), out)
            if last and state["open"] is not None:
                out.append((BETWEEN if state["carried"] else TAIL, bytes(state["open"])))
            count = len(out)
            columns = [
                [own["file"]] * count, [own["start"]] * count, list(range(state["place"], state["place"] + count)),
                [kind for kind, _ in out], [part.decode("utf-8", "replace") for _, part in out],
            ]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "place", "kind", "text"])
            state = {} if last else {**state, "place": state["place"] + count}

    return rows.mapInArrow(run, FOUND)


def records(spark: SparkSession, path: str, key: str = "items") -> DataFrame:
    """(file, text): the JSON text of every record of the documents under the path.

    What the ranges give is written once, since the records that span ranges are put together from it.
    """
    rows = pieces(spark, path)
    known = written(beginnings(written(summaries(rows, key))))
    placed = rows.join(F.broadcast(known), ["file", "start"])
    if known.count() > MOST_SENT:
        numbered = rows.withColumn("order", F.monotonically_increasing_id())
        placed = numbered.join(known, ["file", "start"]).sortWithinPartitions("file", "start", "order").drop("order")
    found = written(cut(placed, key))
    # At most two parts for each range; a record's parts follow its beginning.
    order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    parts = found.where(F.col("kind") != WHOLE).withColumn("number", F.count_if(F.col("kind") == TAIL).over(order))
    put = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "place", "text"))), lambda part: part["text"]), "")
    joined = parts.groupBy("file", "number").agg(put.alias("text")).select("file", "text")
    both = found.where(F.col("kind") == WHOLE).select("file", "text").union(joined)
    broken = both.where(F.get_json_object("text", "$").isNull()).select("file").distinct()
    return both.join(broken, "file", "left_anti")
