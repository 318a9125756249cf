"""Ranked lexical search by an Aho-Corasick scan of all documents.

The terms of all items make one automaton whose patterns are the terms between two blanks. A document is put into the same form, its
other characters turned to blanks, and one scan gives every occurrence of every term as a whole word; two neighbours share their
blank, which the automaton's failure links see. Term frequencies are counts of these occurrences; there is no index of documents.
The outputs of the automaton are numbers of terms, and a table from terms to items turns them into scores.

A first scan counts document frequencies, documents and their terms. A second scan scores, with whole numbers only, and every task
keeps the ``k`` best documents of each item; a window ranks what the tasks kept.

Scale: documents are scanned where they are read and never shuffled. Items are dealt by hash of their row number into blocks of about
``most_pairs`` (item, term) pairs, whose terms are sent to the tasks as the automaton; each block has scans of its own, so tasks and
driver hold a bounded part of an item table of any size (at least one item). Long documents are scanned in pieces cut at blanks, and
scores are computed for a bounded number of (document, item) cells at once. A task sends at most ``k`` rows an item.

Null or empty text has no terms and no rank; items without terms get no rows. Repeated documents are ranked by themselves, equal
scores by ascending doc_id, a null doc_id last. Repeated items, also with a null item_id, are ranked by themselves each. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, stored, table, workers_see_package

BLANK = 32
PIECE = 4 << 20  # bytes of text scanned at once
CELLS = 1 << 21  # (document, item) scores computed at once
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_FORM = np.where(_WORD, np.arange(256), BLANK).astype(np.uint8)
_FORM[65:91] += 32  # A-Z only
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOUND = np.dtype([("end", np.int64), ("term", np.int32)])


class Automaton:
    """Aho-Corasick automaton of terms between blanks, over the bytes of UTF-8 text."""

    def __init__(self, terms: list[str]):
        self.terms = len(terms)
        self.found = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            self.found.add_word(f" {term.encode().decode('latin-1')} ", number)
        if terms:
            self.found.make_automaton()

    def _occurrences(self, form: np.ndarray) -> np.ndarray:
        """Blank that ends each occurrence, and the number of the term."""
        out, at = [], 0
        while at < len(form) - 1:
            until = min(at + PIECE, len(form) - 1)
            back = form[at + 1: until + 1][::-1] == BLANK
            if back.any():
                until -= int(back.argmax())
            else:  # a word longer than a piece
                until += int((form[until:] == BLANK).argmax())
            text = form[at: until + 1].tobytes().decode("latin-1")
            found = np.fromiter(self.found.iter(text), _FOUND) if self.terms else np.zeros(0, _FOUND)
            found["end"] += at
            out.append(found)
            at = until  # the blank that ends a piece begins the next one
        return np.concatenate(out) if out else np.zeros(0, _FOUND)

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each row; and row, term and frequency of every automaton term in a row."""
        form = np.insert(_FORM[data], bounds, BLANK)  # a blank before each row and after the last one
        edges = bounds + np.arange(len(bounds))
        begins = np.flatnonzero((form[:-1] == BLANK) & (form[1:] != BLANK))
        words = np.diff(np.searchsorted(begins, edges))
        found = self._occurrences(form)
        row = np.searchsorted(edges, found["end"], "left") - 1
        key, tf = np.unique(row * max(self.terms, 1) + found["term"], return_counts=True)
        return words, key // max(self.terms, 1), key % max(self.terms, 1), tf


class Best:
    """The ``k`` best (score, doc_id) of every item, ties to the smaller id and a null id last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = np.zeros((4, 0), np.int64)  # item, score, whether the id is null, id

    def add(self, item: np.ndarray, score: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        self.rows = np.concatenate((self.rows, np.stack((item, score, missing, ids)).astype(np.int64)), 1)
        if self.rows.shape[1] > 4 * self.k * len(self.floor) + 10_000:
            self.cut()

    def cut(self) -> None:
        item, score, missing, ids = self.rows
        order = np.lexsort((ids, missing, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.rows = self.rows[:, order[rank < self.k]]
        last = order[rank == self.k - 1]
        self.floor[item[rank == self.k - 1]] = score[last]


def weights(df: list[int], n_docs: int) -> list[int]:
    return [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df]


def _scan(terms: list[str]):
    """Document frequencies of a task's documents: term number and count; -1: documents with a term, -2: all their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, df, docs, words = Automaton(terms), np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, data, bounds in slices(batch):
                n, _, term, _ = automaton.counts(data, bounds)
                df += np.bincount(term, minlength=len(terms))
                docs, words = docs + int((n > 0).sum()), words + int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((seen, [-1, -2])), pa.int64()),
                                          pa.array(np.concatenate((df[seen], [docs, words])), pa.int64())], names=["term", "df"])
    return run


def _rank(terms: list[str], starts: np.ndarray, items: np.ndarray, weight: np.ndarray, n_items: int, n_docs: int, n_words: int, k: int):
    """The best documents of a task: item number, doc_id, score. ``items[starts[t]:starts[t + 1]]`` are the items that hold term t."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, best, held = Automaton(terms), Best(n_items, k), np.diff(starts)
        for batch in batches:
            for rows, data, bounds in slices(batch):
                n, row, term, tf = automaton.counts(data, bounds)
                m = np.array([10 + 90 * x * n_docs // n_words if x else 1 for x in n.tolist()], np.int64)
                part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                ids = rows.column(rows.schema.get_field_index("doc_id"))
                missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                step = max(1, CELLS // n_items)
                for low in range(0, len(n), step):
                    a, b = np.searchsorted(row, (low, low + step))
                    many = held[term[a:b]]
                    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[:-1][term[a:b]], many)
                    cell = np.repeat(row[a:b] - low, many) * n_items + items[at]
                    size = min(step, len(n) - low)
                    score = np.zeros(size * n_items, np.int64)
                    np.add.at(score, cell, np.repeat(part[a:b], many))
                    doc, item = np.nonzero(score.reshape(size, n_items) >= best.floor)
                    best.add(item, score[doc * n_items + item], missing[low + doc], ids[low + doc])
        best.cut()
        item, score, missing, ids = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=missing > 0), pa.array(score)], names=["item", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, most_pairs: int = 200_000) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of the ``k`` best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    workers_see_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    asked = stored(items.select("item_id", F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("terms")), "items")
    asked = stored(asked.withColumn("item_row", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // most_pairs))
    out = spark.createDataFrame([], "item_row long, doc_id long, score long")
    for b in range(blocks):
        block = asked.filter((F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == b) & (F.size("terms") > 0)).select("item_row", "terms").collect()
        if not block:
            continue
        terms = sorted({t for r in block for t in r["terms"]})
        number = {t: i for i, t in enumerate(terms)}
        pairs = sorted((number[t], i) for i, r in enumerate(block) for t in r["terms"])
        starts = np.searchsorted([p[0] for p in pairs], np.arange(len(terms) + 1))
        counted = docs.mapInArrow(_scan(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        df = {r["term"]: r["df"] for r in counted}
        if not df.get(-1):
            continue
        weight = np.array(weights([df.get(i, 0) for i in range(len(terms))], df[-1]), np.int64)
        rank = _rank(terms, starts, np.array([p[1] for p in pairs]), weight, len(block), df[-1], df[-2], k)
        rows = spark.createDataFrame([(i, r["item_row"]) for i, r in enumerate(block)], "item long, item_row long")
        out = out.unionByName(docs.mapInArrow(rank, "item long, doc_id long, score long").join(rows, "item").select("item_row", "doc_id", "score"))
    best = Window.partitionBy("item_row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item_row", "item_id"), "item_row").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, r, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, whole GROUP BY term, docs),
items AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_terms AS (SELECT DISTINCT i, unnest(w) AS term FROM items),
sums AS (SELECT i, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item_terms JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r), whole GROUP BY i, r),
ranked AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sums JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (i) WHERE rank <= 10
"""
