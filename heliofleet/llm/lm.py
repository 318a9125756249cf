"""Hashed maximum-entropy language model over whole texts.

A token's probability is class-factored: P(class | context) * P(token | class). The most frequent tokens and the text end are
classes of their own, all others share ``SHARED`` classes by token hash, in which a token has (c + 1) / (N_class + V_class + 1).
P(class | context) is a softmax over features of the three tokens before: the last one, the last two, the one two back and the one
three back (skips). Features are hashes of the tokens themselves, whatever their frequency; each picks a row of class weights.
There are as many rows as distinct training tokens, rounded up to a power of two, from ``LEAST_ROWS`` to ``MOST_ROWS``, which bounds
the weights (8 MB) that travel to tasks; beyond it features share rows by hash and none is left out.

Training is distributed gradient ascent over all training rows. A weight moves by ``RATE`` * log((observed + s) / (expected + s)), s a
pseudo-count of its class: the sign of its gradient, observed - expected count, at the scale of a log ratio. Rows are dealt by hash
into ``updates`` parts, one an update, so that every row is in one of them and each update meets rows the weights have not seen. The
first needs no softmax, as the untrained model expects the class prior everywhere. A task sums its rows, blocks of feature rows are
summed and moved in Spark, and the driver takes the moves only. Scoring looks the weights up in numpy batches.

Scale: token counts are exact over all training rows (pre-summed per task). The ``TABLE`` most frequent tokens, a fixed number,
travel to the tasks; the counts of all others are joined in Spark by token hash, without hot keys as those are in the table. Up to
``INPUTS`` input partitions share one task's sums in training, so that those stay a small part of the input.

Null text is empty: it is the end token alone. Repeated rows are scored each on its own and count as often as they occur. A very long
text is cut into runs of tokens only for its arithmetic. Tokens are told apart by 64-bit hashes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_fold, slices, stored, table, with_text_columns, workers_see_package
from .words import GRAPHIC, STEPS, mix, words_of

TABLE = 65_536  # tokens whose counts every task holds
OWN = 32  # classes of single tokens; the text end is the first
SHARED = 32
CLASSES = OWN + SHARED
LEAST_ROWS, MOST_ROWS = 1 << 10, 1 << 15
BLOCKS = 32  # of feature rows, each summed on its own
UPDATES = 4
RATE = 0.25  # one share a feature of a token
SMOOTHING = 4.0  # rows' worth of the class prior added to both counts
INPUTS = 16
FEATURES = 4
RUN = 1 << 14  # tokens whose class scores are held at once
END = int(mix(np.array([0xE0F], np.uint64))[0])
START = np.uint64(0x57A7)  # stands before the text
_KINDS = STEPS[:5]  # one odd factor a kind of feature and place


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's tokens with its end, and the bounds of the texts."""
    words = words_of(data, bounds, GRAPHIC)
    n = len(bounds) - 1
    out = np.full(len(words.hash) + n, END, np.uint64)
    out[np.arange(len(words.hash)) + words.row] = words.hash
    return out, words.first + np.arange(n + 1)


def _counts(batches):
    """Token counts of a task, handed on whenever they grow large."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        keys = np.concatenate([k for k, _ in held])
        order = np.argsort(keys)
        keys, numbers = keys[order], np.concatenate([n for _, n in held])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(numbers, first)

    def batch_of(keys, numbers):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(numbers.astype(np.int64))], names=["token", "n"])
    for batch in batches:
        for _, data, bounds in slices(batch):
            held.append(np.unique(tokens_of(data, bounds)[0], return_counts=True))
            size += len(held[-1][0])
            if size > 1_500_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 750_000:
                    yield batch_of(*held[0])
                    held, size = [], 0
    if held:
        yield batch_of(*merged())


class Classes:
    """Class of each token."""

    def __init__(self, own: list[int]):
        rest = [t for t in own if t != END][: OWN - 1]
        self.tokens = np.array([END, *rest], np.uint64)
        self.order = np.argsort(self.tokens)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        ranked = self.tokens[self.order]
        at = np.minimum(np.searchsorted(ranked, tokens), len(ranked) - 1)
        shared = OWN + (tokens & np.uint64(SHARED - 1)).astype(np.int64)
        return np.where(ranked[at] == tokens, self.order[at], shared)


def feature_rows(tokens: np.ndarray, cut: np.ndarray, rows: int) -> np.ndarray:
    """Weight rows of every token's features (4 x tokens): last token, last two, two back, three back."""
    place = np.arange(len(tokens)) - np.repeat(cut[:-1], np.diff(cut))
    one, two, three = (np.full(len(tokens), START) for _ in range(3))
    for back, before in ((1, one), (2, two), (3, three)):
        before[back:] = tokens[:-back]
        before[place < back] = START
    found = (one * _KINDS[0], one * _KINDS[1] + two * _KINDS[2], two * _KINDS[3], three * _KINDS[4])
    return np.stack([(mix(f) >> np.uint64(65 - rows.bit_length())).astype(np.int64) for f in found])


def class_scores(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(score) of every class for each column of feature rows, up to a factor, and the sums of them."""
    scores = weights[at[0]]
    for row in at[1:]:
        scores += weights[row]
    scores += bias
    scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    return scores, scores.sum(1)


def _add_rows(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """``total[at] += values`` with equal rows summed first."""
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    total[ranked[first]] += np.add.reduceat(values[order], first, axis=0)


def _sums(classes: Classes, rows: int, state):
    """Per task: observed and expected counts of (feature row, class) by block; without ``state`` observed ones alone."""
    def run(batches):
        seen = np.zeros(rows * CLASSES, np.float32)
        meant = np.zeros((rows, CLASSES), np.float32)
        for batch in batches:
            for _, data, bounds in slices(batch):
                tokens, cut = tokens_of(data, bounds)
                kind, at = classes.of(tokens), feature_rows(tokens, cut, rows)
                cells, often = np.unique((at * CLASSES + kind).ravel(), return_counts=True)
                seen[cells] += often
                for i in range(0, len(tokens) if state else 0, RUN):
                    part = at[:, i: i + RUN]
                    chance, whole = class_scores(*state.value, part)
                    chance /= whole[:, None]
                    for row in part:
                        _add_rows(meant, row, chance)
        seen = seen.reshape(BLOCKS, -1)
        meant = meant.reshape(BLOCKS, -1)
        for b in range(BLOCKS):
            if seen[b].any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([seen[b].tobytes()], pa.binary()),
                                                  pa.array([meant[b].tobytes() if state else b""], pa.binary())], names=["block", "seen", "meant"])
    return run


def _moves(rows: int, prior: np.ndarray | None):
    """Sum of a block over tasks as the move of its weights; without ``prior`` the sum of observed counts."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, rows // BLOCKS, CLASSES))
        for batch in batches:
            for name, out in zip(("seen", "meant"), total, strict=True):
                for raw in batch.column(batch.schema.get_field_index(name)):
                    if len(raw.as_py()):
                        out += np.frombuffer(raw.as_py(), np.float32).reshape(out.shape)
        move = total[0] if prior is None else move_of(*total, prior)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([move.astype(np.float32).tobytes()], pa.binary())],
                                         names=["block", "move"])
    return run


def move_of(seen: np.ndarray, meant: np.ndarray, prior: np.ndarray) -> np.ndarray:
    return RATE * np.log((seen + SMOOTHING * prior) / (meant + SMOOTHING * prior))


def train(docs: DataFrame, classes: Classes, rows: int, updates: int = UPDATES) -> tuple[np.ndarray, np.ndarray]:
    """Class weights of every feature row, and class biases, from all rows of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-docs.rdd.getNumPartitions() // INPUTS))

    def summed(own: DataFrame, state, prior) -> np.ndarray:
        sums = own.select("text").coalesce(parts).mapInArrow(_sums(classes, rows, state), "block int, seen binary, meant binary")
        found = sums.groupBy("block").applyInArrow(_moves(rows, prior), "block int, move binary").toArrow()  # MOST_ROWS rows at most
        out = np.zeros((BLOCKS, rows // BLOCKS, CLASSES), np.float32)
        for b, raw in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            out[b] = np.frombuffer(raw, np.float32).reshape(out[b].shape)
        return out.reshape(rows, CLASSES)

    deal = F.pmod(F.xxhash64("doc_id", "text"), F.lit(updates))
    seen = summed(docs.filter(deal == 0), None, None).astype(float)
    each = seen.sum(0) / FEATURES + 1
    prior = each / each.sum()
    bias = np.log(prior).astype(np.float32)
    weights = move_of(seen, seen.sum(1, keepdims=True) * prior, prior).astype(np.float32)
    for step in range(1, updates):
        state = spark.sparkContext.broadcast((weights, bias))
        weights = weights + summed(docs.filter(deal == step), state, prior)
        state.unpersist()
    return weights, bias


def scored(docs: DataFrame, training, updates: int = UPDATES) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, counts and both scores; ``training`` is the condition of training rows."""
    spark = docs.sparkSession
    workers_see_package(spark)
    docs = docs.select("doc_id", "text", training.alias("training"))
    own = docs.filter("training")
    counts = own.select("text").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = stored(counts, "counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(whole["n"] or 0), int(whole["v"])
    top = counts.orderBy(F.desc("n"), "token").limit(TABLE).toArrow()
    keys, numbers = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    classes = Classes(keys[:OWN].tolist())
    order = np.argsort(keys)
    keys, numbers = np.concatenate([keys[order], [np.uint64(2**64 - 1)]]), np.concatenate([numbers[order], [0]])
    single = spark.createDataFrame([(int(t),) for t in classes.tokens.view(np.int64)], "token long")
    sizes = counts.join(F.broadcast(single), "token", "left_anti").groupBy((F.col("token").bitwiseAND(SHARED - 1)).alias("k")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # one row a shared class
    rows = min(max(1 << max(distinct - 1, 1).bit_length(), LEAST_ROWS), MOST_ROWS)
    weights, bias = train(own, classes, rows, updates)
    within = np.zeros(CLASSES)
    for k in range(SHARED):
        r = next((r for r in sizes if r["k"] == k), None)
        within[OWN + k] = np.log10((r["n"] + r["v"] if r else 0) + 1)
    shared = spark.sparkContext.broadcast((keys, numbers, weights, bias))

    def compute(_, data, bounds):
        keys, numbers, weights, bias = shared.value
        tokens, cut = tokens_of(data, bounds)
        kind = classes.of(tokens)
        near, log_class = feature_rows(tokens, cut, rows), np.zeros(len(tokens))
        for i in range(0, len(tokens), RUN):
            part, own_class = near[:, i: i + RUN], kind[i: i + RUN]
            chance, whole = class_scores(weights, bias, part)
            log_class[i: i + RUN] = np.log10(np.maximum(chance[np.arange(len(whole)), own_class], 1e-37) / whole)
        at = np.searchsorted(keys[:-1], tokens)
        c = np.where(keys[at] == tokens, numbers[at], 0)
        known = np.add.reduceat(c > 0, cut[:-1], dtype=np.int64)
        log_c = np.add.reduceat(np.log10(c + 1.0), cut[:-1])
        inside = np.where(kind >= OWN, np.log10(c + 1.0) - within[kind], 0.0)
        owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        rare = np.flatnonzero(c == 0)
        order = rare[np.lexsort((tokens[rare], owner[rare]))]
        new = np.ones(len(order), bool)
        new[1:] = (tokens[order][1:] != tokens[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        first = np.flatnonzero(new)
        often = np.diff(np.append(first, len(order))).astype(np.int32)
        ends = np.searchsorted(owner[order][first], np.arange(len(cut))).astype(np.int32)
        return [np.diff(cut), known, log_c, np.add.reduceat(log_class + inside, cut[:-1]),
                pa.ListArray.from_arrays(ends, pa.array(tokens[order][first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(often))]
    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType()))
    fields = T.StructType([T.StructField(n, k) for n, k in zip(("n_tokens", "known_", "log_c", "model_", "rare", "often"), kinds, strict=True)])
    parts = with_text_columns(docs, compute, fields, ["doc_id", "training"]).withColumn("row", F.monotonically_increasing_id())
    parts = stored(parts, "scored")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "often")).alias("t")).select("row", F.col("t.rare").alias("token"), F.col("t.often").alias("often"))
    tail = rare.join(counts, "token").groupBy("row").agg(
        F.sum(F.col("often").cast("long")).alias("more_known"), F.sum(F.col("often") * F.log10(F.col("n") + 1.0)).alias("more_c"))
    unit = float(np.log10(float(total + distinct + 1)))  # add-one: N + 1 * (V + 1)
    return parts.drop("rare", "often").join(tail, "row", "left").select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens",
        (F.col("known_") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_c") + F.coalesce("more_c", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("model_") + F.coalesce("more_c", F.lit(0.0))).alias("score"))


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    """Unigram base score and model score of every document."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, crc_fold(F.col("doc_id"), 7) != 2)
