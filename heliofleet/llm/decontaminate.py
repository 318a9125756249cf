"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``n`` consecutive words of every benchmark item (a shorter item is one window of its own
length). For each pattern length a shift table over two-word blocks says how far the search may jump; where the shift is 0,
the bucket of the block that ends there names the patterns to test, and their words are compared one by one and then as bytes.

Scale: documents are never shuffled. The patterns are cut by hash into sets of about ``max_patterns`` different windows; each set is
one map pass that adds its hits to those of the passes before, so what driver and tasks hold is bounded for benchmarks of any size.
Item ids never travel with the patterns: Spark joins them to the windows that were found. Long documents are searched as many short lanes at once.

Null or empty text has no words and no hits; items without words have no windows; items with a null id mark words as hit but
are not listed. Repeated documents or items are treated like any other rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, stored, table, with_text_columns
from .words import ALNUM, Words, mix, words_of

LANE = 512
TABLE_BITS = 18


class PatternSet:
    """Wu-Manber tables for the patterns of one length ``m``."""

    def __init__(self, patterns: list[bytes], hashes: np.ndarray):
        self.m = hashes.shape[1]
        self.block = min(2, self.m)
        ends = [self.blocks(hashes[:, i: i + self.block]) for i in range(self.m - self.block + 1)]
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.int32)
        for i, keys in enumerate(ends):
            np.minimum.at(self.shift, keys & np.uint64((1 << TABLE_BITS) - 1), self.m - self.block - i)
        order = np.argsort(ends[-1], kind="stable")
        self.suffix, self.hashes, self.patterns = ends[-1][order], hashes[order], [patterns[i] for i in order]

    def blocks(self, words: np.ndarray) -> np.ndarray:
        return mix(words[:, 0] * np.uint64(0x9E3779B97F4A7C15) + words[:, -1])

    def occurrences(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and number of the pattern of every occurrence."""
        m, counts = self.m, words.counts
        long = np.flatnonzero(counts >= m)
        if not len(long):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = -(-(counts[long] - m + 1) // LANE)
        lane = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(words.first[:-1][long] + m - 1, lanes) + lane * LANE
        until = np.minimum(at + LANE, np.repeat(words.first[1:][long], lanes))
        pairs = np.stack((words.hash[:-1], words.hash[1:]), 1) if self.block == 2 else words.hash[:, None]
        keys = self.blocks(pairs)  # of the block that ends at word i + block - 1
        jump = self.shift[keys & np.uint64((1 << TABLE_BITS) - 1)]
        found = []
        while len(at):
            step = jump[at - self.block + 1]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            left = at < until
            at, until = at[left], until[left]
        ends = np.concatenate(found)
        key = keys[ends - self.block + 1]
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        size = high - low
        ends, which = np.repeat(ends, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        for j in range(m):
            same = words.hash[ends - m + 1 + j] == self.hashes[which, j]
            ends, which = ends[same], which[same]
        begin, good = ends - m + 1, np.ones(len(ends), bool)
        for i, (b, p) in enumerate(zip(begin.tolist(), which.tolist(), strict=True)):
            text = b" ".join(data[s:e].tobytes().lower() for s, e in zip(words.start[b: b + m], words.end[b: b + m], strict=True))
            good[i] = text == self.patterns[p]
        return begin[good], which[good]


def _item_windows(n: int):
    def compute(rows, data, bounds):
        words, out = words_of(data, bounds, ALNUM), []
        text = data.tobytes().lower()
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            w = [text[s:e] for s, e in zip(words.start[a:b], words.end[a:b], strict=True)]
            out.append([b" ".join(w[i: i + n]).decode() for i in range(max(1, len(w) - n + 1))] if w else [])
        return [out]
    return compute


def _tables(windows: list[str]) -> list[PatternSet]:
    """Pattern sets by length."""
    by_length: dict[int, list[bytes]] = defaultdict(list)
    for w in windows:
        by_length[w.count(" ") + 1].append(w.encode())
    out = []
    for m, texts in sorted(by_length.items()):
        data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        out.append(PatternSet(texts, words_of(data, bounds, ALNUM).hash.reshape(-1, m)))
    return out


def _search(tables: list[PatternSet], hit: str | None, seen: str | None):
    def compute(rows, data, bounds):
        words = words_of(data, bounds, ALNUM)
        edge = np.zeros(len(words.hash) + 1, np.int64)
        found: dict[int, set[str]] = defaultdict(set)
        for patterns in tables:
            begin, which = patterns.occurrences(data, words)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + patterns.m, -1)
            for row, p in zip((np.searchsorted(words.first, begin, "right") - 1).tolist(), which.tolist(), strict=True):
                found[row].add(patterns.patterns[p].decode())
        covered = np.cumsum(edge[:-1]) > 0
        if hit:
            for row, places in enumerate(rows.column(rows.schema.get_field_index(hit)).to_pylist()):
                covered[words.first[row] + np.array(places, np.int64)] = True
            for row, known in enumerate(rows.column(rows.schema.get_field_index(seen)).to_pylist()):
                if known:
                    found[row].update(known)
        at = np.flatnonzero(covered)
        cut = np.searchsorted(at, words.first)
        places = at - np.repeat(words.first[:-1], np.diff(cut))
        return [words.counts, pa.ListArray.from_arrays(cut.astype(np.int32), places.astype(np.int32)),
                [sorted(found.get(i, ())) for i in range(len(words.counts))]]
    return compute


def windows_of(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Distinct (item_id as text, window)."""
    pair = T.StructType([T.StructField("windows", T.ArrayType(T.StringType()))])
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return (with_text_columns(items, _item_windows(n), pair, ["item_id"])
            .select("item_id", F.explode("windows").alias("window")).distinct())


def contamination(docs: DataFrame, pairs: DataFrame, keep: list[str], max_patterns: int = 200_000) -> tuple[DataFrame, list[str]]:
    """``keep`` columns of ``docs`` and three more, whose names are returned too: number of words, places of the words that are
    hit (from 0), windows that occur. ``pairs`` are those of ``windows_of``."""
    windows = pairs.select("window").distinct()
    sets = max(1, -(-windows.count() // max_patterns))
    bucket = F.pmod(F.xxhash64("window"), F.lit(sets))
    names = [fresh(docs.columns, x) for x in ("n_words_", "hit_", "windows_")]
    fields = T.StructType([T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())),
                           T.StructField(names[2], T.ArrayType(T.StringType()))])
    out = docs
    for k in range(sets):
        rows = [r["window"] for r in windows.filter(bucket == k).collect()]
        own = keep if k == sets - 1 else list(dict.fromkeys([*keep, "text"]))
        if k:
            out = out.withColumnsRenamed({c: f"{c}before" for c in names})
        carried = [f"{c}before" for c in names[1:]] if k else [None, None]
        kept = with_text_columns(out, _search(_tables(rows), *carried), fields, own + [c for c in carried if c])
        out = kept.drop(*[c for c in carried if c])
    return out, names


def items_of(found: DataFrame, windows: str, pairs: DataFrame) -> DataFrame:
    """``items``, the sorted ids of all items whose windows a row of ``found``, a written table with a ``row``, holds: by ``row``."""
    hits = found.select("row", F.explode(windows).alias("window"))
    return hits.join(pairs, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def is_contaminated(n_words: str, hit: str):
    return (F.size(hit) > 0) & (20 * F.size(hit) >= F.col(n_words))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a 13-word window of a benchmark item."""
    docs, pairs = table(spark, sf_dir, "documents").select("doc_id", "text"), stored(windows_of(table(spark, sf_dir, "benchmark")), "windows")
    found, (n_words, hit, windows) = contamination(docs, pairs, ["doc_id"])
    found = stored(found, "found").withColumn("row", F.monotonically_increasing_id())
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.join(stored(items_of(found, windows, pairs), "items"), "row", "left").select(
        "doc_id", F.col(n_words).alias("n_words"), F.size(hit).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(n_words, hit).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS p FROM (
  SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m)),
found AS (SELECT r, i, x.m, item_id FROM places x JOIN patterns y ON y.m = x.m AND y.p = x.p),
hits AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(generate_series(0, m - 1)) AS k FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
