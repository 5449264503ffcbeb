"""Files that are one JSON array each, read by many tasks.

A file is read in pieces between closing braces, which Spark can begin at any byte. Whether a byte
lies in a string, and how deep, depends on all bytes before it, so a block of a file is first summed
up as a map from the state it is entered in to the state it is left in: a string or not, the depth by
which it rises or falls, and how many commas lie at each depth. Composing the maps of a file's blocks
in order, a prefix sum over one row a block, gives the state at the start of each. A second scan then cuts
elements at the commas of depth one. Elements that cross blocks come as fragments, the only texts that are shuffled,
and are put together by their number.

There is no limit on a file's size. A file that doesn't end where its array does gives one row, which no parser
accepts; an element that isn't JSON is a row like others, which the parser rejects with its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What ends a piece; a record's object ends with one.
END = "}"
QUOTE, SLASH, COMMA = b'"\\,'
OPEN, CLOSE = b"{[", b"}]"
#: Blocks whose states are broadcast, about 150 bytes each; beyond that blocks meet them by a shuffle.
MOST_BLOCKS = 500_000
#: What stands for a file whose array isn't closed, or goes on after its end.
BROKEN = "JSON array that does not end with its file"


def lex(data: bytes, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Bytes, whether each lies outside strings, the depth behind each, and the state after all of them."""
    a = np.frombuffer(data, np.uint8)
    quote = a == QUOTE
    slashes = np.flatnonzero(a == SLASH)
    if len(slashes):
        # a run of backslashes of odd length escapes what follows it
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        size = np.diff(first, append=len(slashes))
        behind = slashes[first] + size
        behind = behind[(size % 2 == 1) & (behind < len(a))]
        quote[behind] = False
    outside = (np.cumsum(quote) + inside) % 2 == 0
    step = np.isin(a, list(OPEN)).astype(np.int32) - np.isin(a, list(CLOSE))
    depths = depth + np.cumsum(np.where(outside, step, 0))
    return a, outside, depths, int(inside + quote.sum()) % 2, int(depths[-1]) if len(a) else depth


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, tuple, bytes]]:
    """Pieces by file and block, each with the brace before it; what follows the first columns comes along."""
    for batch in batches:
        files, blocks, values = (batch.column(k) for k in range(3))
        rest = list(zip(*(batch.column(k).to_pylist() for k in range(3, batch.num_columns)), strict=True)) or [()] * batch.num_rows
        keys = list(zip(files.to_pylist(), blocks.to_pylist(), strict=True))
        pieces = values.cast(pa.binary()).to_pylist()
        begin = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[begin]:
                yield *keys[begin], rest[begin], pieces[begin:k]
                begin = k


def _joined(pieces: list[bytes], start: bool) -> bytes:
    return (b"" if start else END.encode()) + END.encode().join(pieces)


SUMMARY = "file string, block long, quotes int, rise_0 long, rise_1 long, commas_0 map<long,long>, commas_1 map<long,long>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its map for both states in which it can be entered."""
    key, state, commas = None, [(0, 0), (1, 0)], [{}, {}]

    def row() -> pa.RecordBatch:
        kind = pa.map_(pa.int64(), pa.int64())
        values = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([state[0][0]], pa.int32()), *(pa.array([s[1]], pa.int64()) for s in state), *(pa.array([list(c.items())], kind) for c in commas)]
        return pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in SUMMARY.split(", ")])

    for file, block, _, pieces in _blocks(batches):
        start = key != (file, block)
        if start:
            if key:
                yield row()
            key, state, commas = (file, block), [(0, 0), (1, 0)], [{}, {}]
        data = _joined(pieces, start and block == 0)
        for s in (0, 1):
            a, outside, depths, *state[s] = lex(data, *state[s])
            at, n = np.unique(depths[(a == COMMA) & outside], return_counts=True)
            for depth, k in zip(at.tolist(), n.tolist(), strict=True):
                commas[s][depth] = commas[s].get(depth, 0) + k
    if key:
        yield row()


FRAGMENT = "file string, block long, nth long, value string, whole boolean"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts between commas of depth one, with the number of their element."""
    key, entry, held, out = None, None, [], []
    inside, depth, nth, left = 0, 0, 0, False

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()).cast(pa.string()), pa.array(columns[4])], names=[c.split()[0] for c in FRAGMENT.split(", ")])

    for file, block, rest, pieces in _blocks(batches):
        start = key != (file, block)
        if start:
            if key:
                out.append((*key, nth, b"".join(held), left and entry[3]))
            key, entry, held = (file, block), rest, []
            inside, depth, nth, _ = entry
            left = block == 0  # whether the fragment at hand has its beginning
        data = _joined(pieces, start and block == 0)
        a, outside, depths, inside, depth = lex(data, inside, depth)
        begin = 0
        for cut in np.flatnonzero((a == COMMA) & outside & (depths == 1)).tolist():
            out.append((*key, nth, b"".join([*held, data[begin:cut]]), left))
            held, begin, nth, left = [], cut + 1, nth + 1, True
        held.append(data[begin:])
        if len(out) > 1000:
            yield batch()
    if key:
        out.append((*key, nth, b"".join(held), left and entry[3]))
    if out:
        yield batch()


def _entries(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State and number of the first element at each block's start, and whether each file ends well."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0))
    known = blocks.withColumn("inside", inside.cast("int"))
    by_state = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))
    known = known.select("file", "block", "inside", "quotes", by_state("rise").alias("rise"), by_state("commas").alias("commas"))
    known = known.withColumn("depth", F.coalesce(F.sum("rise").over(before), F.lit(0)))
    cuts = F.coalesce(F.try_element_at("commas", F.lit(1) - F.col("depth")), F.lit(0))
    known = known.withColumn("cuts", cuts).withColumn("nth", F.coalesce(F.sum("cuts").over(before), F.lit(0)))
    last = F.lead("block").over(order).isNull()
    entries = known.select("file", "block", "inside", F.col("depth").cast("int").alias("depth"), "nth", last.alias("last"))
    files = known.groupBy("file").agg((F.sum("rise") == 0).alias("flat"), (F.sum("quotes") % 2 == 0).alias("even"), F.sum("cuts").alias("cuts"))
    return entries, files.select("file", (F.col("flat") & F.col("even")).alias("ends"), "cuts")


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """position (file, 0, number of the element) and value of the elements of files that are one JSON array each."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    pieces = spark.read.text(path, lineSep=END).select(*place, "value")
    # one short row a block, kept so that the scan behind it isn't repeated for each use
    blocks = pieces.mapInArrow(_summaries, SUMMARY).persist()
    entries, files = _entries(blocks)
    if blocks.count() <= MOST_BLOCKS:
        entered = pieces.join(F.broadcast(entries), ["file", "block"])
        files = F.broadcast(files)
    else:
        numbered = pieces.withColumn("row", F.monotonically_increasing_id())
        entered = numbered.join(entries, ["file", "block"]).sortWithinPartitions("file", "block", "row").drop("row")
    found = entered.select("file", "block", "value", "inside", "depth", "nth", "last").mapInArrow(_fragments, FRAGMENT)
    whole = found.where("whole").select("file", "nth", "value")
    parts = found.where("not whole").groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("x"))
    both = whole.unionByName(parts.select("file", "nth", F.array_join("x.value", "").alias("value")))
    # brackets of the array belong to its first and last element
    opened = F.when(F.col("nth") == 0, F.regexp_replace("value", r"^[\s\x{FEFF}]*+\[", "")).otherwise(F.col("value"))
    rows = both.join(files, "file").where("ends").withColumn("value", opened)
    closed = F.when(F.col("nth") == F.col("cuts"), F.regexp_replace("value", r"\](?=\s*+$)", "")).otherwise(F.col("value"))
    rows = rows.withColumn("value", F.regexp_replace(closed, r"^\s++|(?<!\s)\s++$", "")).where("cuts > 0 or value <> ''")
    bad = files.where("not ends").select("file", F.lit(0).cast("long").alias("nth"), F.lit(BROKEN).alias("value"))
    rows = rows.select("file", "nth", "value").unionByName(bad)
    return rows.select(F.struct("file", F.lit(0).cast("long").alias("block"), F.col("nth").alias("row")).alias("position"), "value")
