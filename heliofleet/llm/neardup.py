"""MinHash near-duplicates by an inverted join over signature coordinates.

Documents with the same set of five-word shingles are one class; one row per class goes on. A class has a signature of 64
minima, and is posted under every (coordinate, value) pair. Two sets of similarity 0.75 agree in 48 of 64 coordinates on
average; a pair that agrees in fewer than ``MATCHES`` = 32 is not retained (a linked pair is lost with probability 1e-5 at
exactly 0.75 and vanishing above). Prefix and skip merging: pairs are ordered by how many classes share them, rarest first. Two
classes that agree in t of 64 coordinates must meet in the first 64 - t + 1 of both, so the longest lists are skipped when
postings are merged and only read when the collisions of a pair are counted on its signatures. A class with fewer than t shared
pairs leaves at once; that is most of them.

Copies are not expanded into all pairs. Each list compares its members with one leader, the member that shares most
coordinates with others (the original of a group of edited copies), on the full shingle sets; a second leader takes in
what the first left outside. What is then still in different
components of some list meets by the rarest shingle the two sets can share (``_rare_meetings``), not by the list: pages of one template that
are not similar enough never meet, and no link between components is lost. Components are found in Spark.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Null or wordless text: no shingles, a component of its own.
Fewer than five words: the whole sequence is the one shingle. Repeated rows are copies of each other; the kept row is decided
by doc_id, so rows that repeat a doc_id are kept or dropped together. A null doc_id counts for no component id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import stored, table, with_text_columns
from .words import GRAPHIC, mix, window_hashes, words_of

SHINGLE = 5
COORDINATES = 64
MATCHES = 32
SIMILARITY = (75, 100)
FURTHER_LEADERS = 1

_ODD = np.random.Generator(np.random.PCG64(9)).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and the bounds of the rows."""
    words = words_of(data, bounds, GRAPHIC)
    row, counts = words.row, words.counts
    hashes = window_hashes(words.hash, SHINGLE)
    owner = row[: len(hashes)]
    inside = owner == row[SHINGLE - 1:] if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[inside], owner[inside]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = [window_hashes(words.hash[words.first[i]: words.first[i + 1]], int(counts[i]))[0] for i in short]
        hashes, owner = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _signatures(rows, data, bounds):
    hashes, cut = shingle_sets(data, bounds)
    size = np.diff(cut)
    full = np.flatnonzero(size)
    keys = np.zeros((2, len(size)), np.uint64)
    minima = np.zeros((len(full), COORDINATES), np.uint32)
    if len(full):
        at = cut[:-1][full]
        keys[0, full] = np.add.reduceat(mix(hashes), at)
        keys[1, full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at)
        for j, factor in enumerate(_ODD):
            minima[:, j] = np.minimum.reduceat(hashes * factor, at) >> np.uint64(32)
    offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, COORDINATES, 0))]).astype(np.int32)
    return [size, keys[0].view(np.int64), keys[1].view(np.int64), pa.ListArray.from_arrays(offsets, pa.array(minima.ravel().view(np.int32)))]


_PROFILE = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("key1", T.LongType()),
                         T.StructField("key2", T.LongType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])


def _sets(rows, data, bounds):
    hashes, cut = shingle_sets(data, bounds)
    raw = hashes.tobytes()
    return [[raw[8 * a: 8 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]]


def _measure(batches):
    """Size of the intersection and of both sets of each pair."""
    for batch in batches:
        counts = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            counts.append((int(np.count_nonzero(both[1:] == both[:-1])), len(x), len(y)))
        columns = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns.T)], names=["a", "b", "common", "na", "nb"])


def _unfolded(batches):
    """One row per shingle of each set, with the size of the set."""
    for batch in batches:
        names = batch.schema.names
        rid, c, raw = (batch.column(names.index(x)) for x in ("rid", "c", "shingles"))
        for i in range(0, len(raw), 256):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in raw.slice(i, 256)]
            n = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.repeat(x.slice(i, 256).to_numpy(), n)) for x in (rid, c)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))],
                names=["rid", "c", "n", "h"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return stored(_with_sets(pairs, sets).mapInArrow(_measure, "a long, b long, common long, na long, nb long"), "measured")


def _links(measured: DataFrame) -> DataFrame:
    return measured.filter(SIMILARITY[1] * F.col("common") >= SIMILARITY[0] * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs with at least MATCHES equal coordinates: the skipped lists are read here."""
    a = signatures.select(F.col("rid").alias("a"), F.col("signature").alias("x"))
    b = signatures.select(F.col("rid").alias("b"), F.col("signature").alias("y"))
    equal = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.join(a, "a").join(b, "b").filter(equal >= MATCHES).select("a", "b")


def _mixed(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings of lists whose members are in more than one component, with the component ``c``."""
    placed = lists.join(groups.withColumnRenamed("node", "rid"), "rid", "left").withColumn("c", F.coalesce("component", "rid")).drop("component")
    several = placed.groupBy("pair").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("pair")
    return stored(placed.join(several, "pair"), "mixed")


def _leaders(lists: DataFrame) -> DataFrame:
    return lists.groupBy("pair").agg(F.max(F.struct("weight", "rid")).alias("m")).select("pair", F.col("m.rid").alias("leader"))


def _links_of(lists: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect exactly what all links connect."""
    ahead = stored(lists.join(_leaders(lists), "pair"), "led")
    first = _measured(ahead.filter("rid <> leader").select(F.col("rid").alias("a"), F.col("leader").alias("b")).distinct(), sets)
    links = _links(first)
    groups = components(links)
    for _ in range(FURTHER_LEADERS):
        mixed = _mixed(ahead, groups)
        at = groups.select(F.col("node").alias("leader"), F.col("component").alias("theirs"))
        outside = mixed.join(at, "leader", "left").filter(F.col("c") != F.coalesce("theirs", "leader"))
        next_leader = _leaders(outside).withColumnRenamed("leader", "second").join(
            outside.select("pair", F.col("rid").alias("second"), F.col("c").alias("c2")), ["pair", "second"])
        more = mixed.join(next_leader, "pair").filter("c <> c2").select(F.col("rid").alias("a"), F.col("second").alias("b")).distinct()
        more = _links(_measured(_agreeing(more.join(first.select("a", "b"), ["a", "b"], "left_anti"), signatures), sets))
        if more.isEmpty():
            break
        links = links.union(more)
        groups = components(links)
    mixed = _mixed(ahead, groups)
    members = stored(mixed.select("rid", "c").distinct(), "members")
    return links.union(_links(_measured(_rare_meetings(members, sets), sets)))


def _band(size):
    """Sizes in steps of four per cent."""
    return F.floor(F.log(size.cast("double")) * 25 + 1e-9).cast("int")


def _rare_meetings(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ``members`` in different components that can be linked, by the rarest shingle they share.

    Shingles are ordered by how many members hold them, rarest first. Sets of n and m shingles are linked if they share k with
    7 k >= 3 (n + m). If the first one they share stands at place p of the first set (from 0), then k <= n - p, so
    m <= 7 (n - p) / 3 - n. Each set is therefore posted under its early shingles, for the bands of partner sizes that bound
    allows; what a whole family shares stands too late to be posted. Shingles of one component only have no partner.
    """
    spread = members.join(sets, "rid").mapInArrow(_unfolded, "rid long, c long, n long, h long")
    spread = stored(spread, "shingles")
    held = spread.groupBy("h").agg(F.count(F.lit(1)).alias("f"), (F.min("c") < F.max("c")).alias("across"))
    ranked = spread.join(held, "h").groupBy("rid", "c", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h", "across"))).alias("own"))
    placed = ranked.select("rid", "c", "n", F.posexplode("own").alias("p", "s")).filter("s.across")
    least, most = F.expr("(3 * n + 3) div 4"), F.expr("least((7 * (n - p)) div 3 - n, (4 * n) div 3)")
    posted = placed.withColumns({"least": least, "most": most}).filter("least <= most").select(
        "rid", "c", "n", F.col("s.h").alias("h"), (F.col("n") - F.col("p")).alias("left"), _band(F.col("n")).alias("mine"),
        F.explode(F.sequence(_band(F.col("least")), _band(F.col("most")))).alias("theirs"))
    posted = stored(posted, "rare")
    other = posted.select("h", *[F.col(x).alias(y) for x, y in (("rid", "b"), ("c", "c2"), ("n", "n2"), ("left", "left2"), ("mine", "theirs"), ("theirs", "mine"))])
    met = posted.withColumnRenamed("rid", "a").join(other, ["h", "mine", "theirs"]).filter(
        (F.col("c") < F.col("c2")) & F.expr("3 * (n + n2) <= 7 * least(left, left2)"))
    return stored(met.select("a", "b").distinct(), "meetings")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, and ``text_hash`` (xxhash64 of the text) to find the row again."""
    docs = docs.select("doc_id", "text")
    profile = with_text_columns(docs.withColumn("text_hash", F.xxhash64("text")), _signatures, _PROFILE, ["doc_id", "text_hash"])
    profile = stored(profile.withColumn("rid", F.monotonically_increasing_id()), "profiles")
    classes = profile.filter("n_shingles > 0").groupBy("key1", "key2").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_id"))
    classes = stored(classes, "classes")
    signatures = profile.join(classes.select("rid"), "rid", "left_semi").select("rid", "doc_id", "text_hash", "signature")

    posted = signatures.select("rid", F.posexplode("signature").alias("j", "v")).select(
        "rid", (F.col("j").cast("long") * F.lit(1 << 32) + F.col("v").cast("long") - F.lit(-(1 << 31))).alias("pair"))
    shared = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    lists = posted.join(shared, "pair").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("f", "pair"))).alias("own"))
    lists = lists.filter(F.size("own") >= MATCHES).select(
        "rid", F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["f"]).alias("weight"),
        F.explode(F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1))).alias("own"))
    lists = stored(lists.select("rid", "weight", F.col("own.pair").alias("pair")), "postings")
    alone = lists.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pair")
    lists = stored(lists.join(alone, "pair"), "postings")

    wanted = stored(signatures.join(lists.select("rid").distinct(), "rid"), "wanted")
    ids = wanted.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "rid")
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("h"))).select("rid", "text")
    sets = with_text_columns(texts, _sets, T.StructType([T.StructField("shingles", T.BinaryType())]), ["rid"])
    sets = stored(sets.dropDuplicates(["rid"]), "sets")
    groups = components(_links_of(lists, wanted, sets))

    named = classes.join(groups.withColumnRenamed("node", "rid"), "rid", "left").select(
        "key1", "key2", "first_id", F.coalesce("component", "rid").alias("c"))
    lowest = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "c").select("key1", "key2", "component_id")
    out = profile.select("doc_id", "text_hash", "n_shingles", "key1", "key2")
    full = out.filter("n_shingles > 0").join(named, ["key1", "key2"]).select("doc_id", "text_hash", "n_shingles", "component_id")
    bare = out.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS h
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
"""
