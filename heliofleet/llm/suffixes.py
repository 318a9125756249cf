"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept only where content selects them: at the words whose 16-word gram has the smallest hash in some window of 33
grams (a minimiser). Any passage of 50 words or more holds such a word among its first 33, so equal passages keep suffixes at
equal places, and at least 18 words follow. Suffixes whose first 18 words occur in one document only leave. The others are
sorted by what follows (then by what precedes), each is compared with its nearest neighbours from another document in either
direction, and the match is extended to the right and to the left, as far as the next selected words reach. Matches of
``MIN_WORDS`` words or more count; overlapping matches of a document are one passage.

Neighbours in the order share the longest continuation, so a match that is shorter to the right but longer to the left than both
neighbours' is not seen there. Every 50-word window therefore belongs to the minimiser of its first 33 grams, and the windows of a
suffix that its neighbours leave open (as long to the right as the longest continuation allows, not matched already) are counted by
hash: those that occur in two documents are passages too. This makes detection exact up to hash collisions.

Scale: about one suffix in 17 words is kept, as (hash, document, place). Texts are read a second time only for documents with
repeated suffixes. Sorting is by range over key, context and document, so a passage that a third of all documents share is
spread over tasks; the first and the last run of each task (one key in one document) are compared afterwards, with the rows next
to them. Window hashes are summed up per task before they are dealt out; only open windows are joined with the repeated ones.
Nothing compares all pairs of a group.

Words are ``[^\\x20\\x09-\\x0D]+`` as written. Null, empty and shorter texts have no passages. Rows that repeat both doc_id and text
are one document. Repeats inside one document alone do not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored, table, with_text_columns
from .words import EXACT, GRAPHIC, STEPS, mix, window_hashes, words_of

MIN_WORDS = 50
GRAM = 16
WINDOW = 33  # a power of two and one
KEY = 18
REACH = 50


def _running(x: np.ndarray, pick) -> np.ndarray:
    """``pick`` over every WINDOW consecutive entries."""
    out, width = x, 1
    while 2 * width < WINDOW:
        out, width = pick(out[:-width], out[width:]), 2 * width
    return pick(out[:-1], x[WINDOW - 1:]) if len(x) >= WINDOW else x[:0]


def selected(words) -> np.ndarray:
    """Indexes of the minimiser words that have KEY words from there on in their row."""
    grams = window_hashes(words.hash, GRAM) | np.uint64(1)
    span = WINDOW + GRAM - 1
    row = words.row
    if len(row) < span:
        return np.zeros(0, np.int64)
    least = _running(grams, np.minimum)
    least = np.where(row[: len(least)] == row[span - 1:], least, np.uint64(0))  # windows across rows select nothing
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    at = np.flatnonzero(_running(padded, np.maximum)[: len(grams)] == grams)
    at = at[at + KEY <= len(row)]
    return at[row[at] == row[at + KEY - 1]]


def _suffixes(rows, data, bounds):
    words = words_of(data, bounds, GRAPHIC, EXACT)
    at = selected(words)
    keys = window_hashes(words.hash, KEY)[at] if len(at) else np.zeros(0, np.uint64)
    cut = np.searchsorted(at, words.first).astype(np.int32)
    places = (at - np.repeat(words.first[:-1], np.diff(cut))).astype(np.int32)
    return [pa.ListArray.from_arrays(cut, pa.array(places)), pa.ListArray.from_arrays(cut, pa.array(keys.view(np.int64)))]


def _contexts(rows, data, bounds):
    words = words_of(data, bounds, GRAPHIC, EXACT)
    short = (words.hash >> np.uint64(32)).astype("<u4")
    wanted = rows.column(rows.schema.get_field_index("places")).to_pylist()
    keys = window_hashes(words.hash, KEY).view(np.int64)
    owner = _owners(words)
    out = []
    for places, a, b in zip(wanted, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        at = np.array(places or (), np.int64) + a
        low = at - np.minimum(np.searchsorted(owner, at, "right") - 1, b - MIN_WORDS)
        high = at - np.maximum(np.searchsorted(owner, at), a)
        out.append([(p, int(keys[a + p]), short[a + p + KEY: min(b, a + p + REACH)].tobytes(), short[max(a, a + p - WINDOW): a + p][::-1].tobytes(), lo, hi)
                    for p, lo, hi in zip(places or (), low.tolist(), high.tolist(), strict=True)])
    return [[[dict(zip(("place", "key", "right", "left", "low", "high"), x, strict=True)) for x in each] for each in out]]


def _owners(words) -> np.ndarray:
    """The first minimiser of the WINDOW grams from each word on; in ascending order."""
    grams = window_hashes(words.hash, GRAM) | np.uint64(1)
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(1) + np.arange(len(grams) - WINDOW + 1)


_CONTEXT = T.StructType([T.StructField("each", T.ArrayType(T.StructType([
    T.StructField("place", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("right", T.BinaryType()),
    T.StructField("left", T.BinaryType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])))])
_OUT = ("doc long, doc_id long, other_id long, begin int, end int, edge boolean, key long, right binary, left binary, place int, low int, high int, "
        "known array<long>, open array<long>, starts array<int>")  # edge is null in rows of windows
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_SUFFIX = ["doc", "doc_id", "key", "right", "left", "place", "low", "high"]  # low, high: words to the left in the windows of the suffix
_LISTS = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _words_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]) // 4
    out = np.zeros((len(column), REACH), np.uint32)
    flat = np.frombuffer(b"".join(column.to_pylist()), "<u4")
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def _runs(rows: pa.Table) -> np.ndarray:
    """Where a run of one key and document begins."""
    doc, key = rows.column("doc").to_numpy(), rows.column("key").to_numpy()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return np.flatnonzero(new)


def matches(rows: pa.Table):
    """Of sorted suffixes: which have a match with the nearest other document before or after, its begin and end, and the other row;
    the words that follow and precede, and how many of them are equal before and after (-1 without such a row)."""
    n = rows.num_rows
    doc, key, place = (rows.column(c).to_numpy() for c in ("doc", "key", "place"))
    sides = [_words_matrix(rows.column(c).combine_chunks()) for c in ("right", "left")]
    run = np.zeros(n, bool)
    run[_runs(rows)] = True
    start = np.maximum.accumulate(np.where(run, np.arange(n), 0))
    stop = np.append(np.flatnonzero(run)[1:], n)[np.cumsum(run) - 1]
    begin, end, other, found = place.astype(np.int64), place.astype(np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    equal = np.full((2, 2, n), -1)
    for side, near in enumerate((start - 1, stop)):
        at = np.flatnonzero((near >= 0) & (near < n))
        at = at[key[at] == key[near[at]]]
        reach = []
        for words, size in sides:
            both = np.minimum(size[at], size[near[at]])
            same = (words[at] == words[near[at]]) & (np.arange(REACH) < both[:, None])
            reach.append(np.where(same.all(1), REACH, same.argmin(1)))
        equal[side][:, at] = reach
        good = reach[0] + reach[1] + KEY >= MIN_WORDS
        at, right, left = at[good], reach[0][good], reach[1][good]
        begin[at], end[at] = np.minimum(begin[at], place[at] - left), np.maximum(end[at], place[at] + KEY + right)
        other[at], found[at] = near[at], True
    return found, begin, end, other, sides, equal


def _windows(rows: pa.Table, compared, begin: int, stop: int, before: int, after: int):
    """Window hashes of rows begin..stop: those their neighbours have too, and those left open, with the words where they start.
    The first rows up to ``before`` and those from ``after`` on have a neighbour that is not seen here."""
    if "low" not in rows.column_names:
        return
    (right, right_size), (left, left_size) = compared[4]
    equal = compared[5]
    longest = equal[:, 0].max(0)
    longest[:before] = longest[after:] = REACH
    key, low, high, place = (rows.column(c).to_numpy()[begin:stop, None] for c in ("key", "low", "high", "place"))
    part, most = slice(begin, stop), MIN_WORDS - KEY
    back = np.arange(most + 1)  # words to the left of the key
    ahead = most - back
    inside = (back >= low) & (back <= high) & (back <= left_size[part, None]) & (ahead <= right_size[part, None]) & (ahead <= longest[part, None])
    if not inside.any():
        return
    known = np.zeros_like(inside)
    for after_key, before_key in equal:
        known |= inside & (back <= before_key[part, None]) & (ahead <= after_key[part, None])
    sums = []
    for words, first in ((right, 0), (left, WINDOW)):
        total = np.zeros((stop - begin, most + 1), np.uint64)
        np.cumsum(words[part, :most].astype(np.uint64) * STEPS[first: first + most], axis=1, out=total[:, 1:])
        sums.append(total)
    hashes = mix(key.view(np.uint64) + sums[0][:, ahead] + sums[1] + STEPS[2 * WINDOW + back]).view(np.int64)
    some = np.flatnonzero(inside.any(1))
    lists = []
    for mask, values in ((known, hashes), (inside & ~known, hashes), (inside & ~known, (place - back).astype(np.int32))):
        cut = np.concatenate([[0], np.cumsum(mask[some].sum(1))]).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(values[some][mask[some]])))
    own = [rows.column(c).combine_chunks().take(pa.array(some + begin)) for c in ("doc", "doc_id")]
    blank = [pa.nulls(len(some), x) for x in (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32())]
    yield pa.RecordBatch.from_arrays([*own, *blank, *lists], names=_NAMES)


def _compare(batches):
    """Matches of sorted suffixes, and the borders of the task: its first run and the row after, its last run and the row before."""
    held, head = [], True
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if len(_runs(held[-1])) > 1:
            rows = pa.concat_tables(held)
            runs = _runs(rows)
            compared = matches(rows)
            yield from _found(rows, compared)
            yield from _windows(rows, compared, 0 if head else 1, runs[-1], runs[1] if head else 0, rows.num_rows)
            if head:
                yield _edges(rows.slice(0, runs[1] + 1))
            held, head = [rows.slice(max(0, runs[-1] - 1))], False
    rows = pa.concat_tables(held) if held else None
    if rows:
        runs = _runs(rows)
        compared = matches(rows)
        yield from _found(rows, compared)
        yield from _windows(rows, compared, 0 if head else 1, rows.num_rows, (runs[1] if len(runs) > 1 else rows.num_rows) if head else 0, runs[-1])
        yield _edges(rows if head else rows.slice(max(0, runs[-1] - 1)))


def _edges(rows: pa.Table) -> pa.RecordBatch:
    n = rows.num_rows
    none = pa.nulls(n, pa.int32())
    own = [rows.column(c).combine_chunks() if c in rows.column_names else none for c in _SUFFIX]
    return pa.RecordBatch.from_arrays([*own[:2], pa.nulls(n, pa.int64()), none, none, pa.array([True] * n), *own[2:], *[pa.nulls(n, x) for x in _LISTS]], names=_NAMES)


def _found(rows: pa.Table, compared):
    found, begin, end, other = compared[:4]
    at = np.flatnonzero(found)
    if len(at):
        ids, n = rows.column("doc_id").combine_chunks(), len(at)
        yield pa.RecordBatch.from_arrays([
            rows.column("doc").combine_chunks().take(pa.array(at)), ids.take(pa.array(at)), ids.take(pa.array(other[at])), pa.array(begin[at].astype(np.int32)),
            pa.array(end[at].astype(np.int32)), pa.array([False] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
            *[pa.nulls(n, pa.int32())] * 3, *[pa.nulls(n, x) for x in _LISTS]], names=_NAMES)


def _open_windows(compared: DataFrame) -> DataFrame:
    """Windows that no neighbour in the order has and another document repeats, as matches."""
    rows = compared.filter("edge IS NULL")
    held = rows.select("doc", F.explode("known").alias("window"), F.lit(False).alias("open")).union(
        rows.select("doc", F.explode("open").alias("window"), F.lit(True).alias("open")))
    repeated = held.groupBy("window").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("open").alias("open"))
    repeated = stored(repeated.filter("a <> b AND open").drop("open"), "repeated")  # on its own, so that the last join may split a hot window
    ids = rows.groupBy("doc").agg(F.min("doc_id").alias("id"))
    named = repeated.join(ids.select(F.col("doc").alias("a"), F.col("id").alias("a_id")), "a").join(
        ids.select(F.col("doc").alias("b"), F.col("id").alias("b_id")), "b")
    each = rows.select("doc", "doc_id", F.explode(F.arrays_zip("open", "starts")).alias("w"))
    each = each.select("doc", "doc_id", F.col("w.starts").alias("begin"), F.col("w.open").alias("window"))
    other = F.when(F.col("a") == F.col("doc"), F.col("b_id")).otherwise(F.col("a_id"))
    return each.join(stored(named, "named"), "window").select("doc", "doc_id", other.alias("other_id"), "begin", (F.col("begin") + MIN_WORDS).alias("end"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, start_word, end_word, other_doc_id)``: every passage of a document that another document repeats."""
    docs = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pair = T.StructType([T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType()))])
    kept = with_text_columns(docs, _suffixes, pair, ["doc"]).select("doc", F.explode(F.arrays_zip("places", "keys")).alias("s"))
    kept = stored(kept.select("doc", F.col("s.places").alias("place"), F.col("s.keys").alias("key")), "suffixes")
    shared = kept.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select("key")
    shared = stored(shared, "shared")  # on its own, so that the join below may split the suffixes of a hot key
    wanted = kept.join(shared, "key").groupBy("doc").agg(F.array_sort(F.collect_set("place")).alias("places"))
    texts = docs.join(wanted, "doc").dropDuplicates(["doc"])
    contexts = with_text_columns(texts, _contexts, _CONTEXT, ["doc", "doc_id", "places"])
    contexts = stored(contexts.select("doc", "doc_id", F.explode("each").alias("s")).select("doc", "doc_id", "s.*"), "contexts")
    order = ["key", "right", "left", "doc", "place"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = stored(contexts.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_compare, _OUT), "compared")
    edges = compared.filter("edge").select(*_SUFFIX).repartition(1).sortWithinPartitions(*order)  # two runs a task
    late = edges.mapInArrow(_compare, _OUT).filter("not edge")
    spans = compared.filter("not edge").union(late).select("doc", "doc_id", "other_id", "begin", "end").union(_open_windows(compared))
    by_doc = Window.partitionBy("doc").orderBy("begin", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("begin") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by_doc))
    return islands.groupBy("doc", "doc_id", "island").agg(
        F.min("begin").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"), F.min("other_id").alias("other_doc_id")).select(
        "doc_id", "start_word", "end_word", "other_doc_id")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))
