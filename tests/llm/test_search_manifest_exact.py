"""Lexical search, Merkle manifest and exact duplicates against plain versions on difficult rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliofleet.llm import exact, lexical, merkle

DOC = ("doc_id long, text string, lang string, source string, n_chars long, hash string, record string, size string, pos string, n string, "
       "node string, grp string, path string, item string, term string, rank string, score string, df string, keeper string")
LONG = " ".join(f"w{i * 31 % 9973}" for i in range(30_000))
TEXTS = [None, "", " \n", "One two, two THREE", "one-two", "one", "straße é one", LONG, LONG, "thirteen onetwo", "two two x1y _one_", "ONE TWO TWO THREE"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = ["one", "two", "three", "Four", "five5", "étude", "и"]
    texts = TEXTS + [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(500)] + ["copy of one"] * 300
    rows = [(None if i % 97 == 13 else i // 2 if i % 50 == 7 else i, t, [None, "", "en", "en", "en", "fr", "Ω", "="][i % 8 if i % 3 else 2],
             None if i % 11 == 3 else "s", None if i % 7 == 2 else len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([(*r, *["x"] * 14) for r in rows + rows[:40]], DOC)


def lists(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def ranked(docs, items, k=10):
    counts = [(i, Counter(lists(t)), len(lists(t))) for i, t in docs if lists(t)]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counts:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(lists(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return out


ITEMS = [(0, "two ONE three three"), (1, ""), (2, None), (3, "absent words"), (None, "étude, и étude"), (None, "five5"), (4, "straße onetwo w31"), (4, "straße onetwo w31"), (5, "x1y one_two")]


@pytest.mark.parametrize("most_pairs", [200_000, 3])
def test_lexical_search(spark, docs, most_pairs):
    items = spark.createDataFrame([(*r, "x", "x") for r in ITEMS], "item_id long, text string, terms string, item_row string")
    got = Counter(tuple(r) for r in lexical.search(docs, items, most_pairs=most_pairs).collect())
    assert got == Counter(ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS))


def test_lexical_search_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    a = lexical.Automaton(["one", "two", "averylongword"])
    raw = b"one one two averylongword two one" + b"" + b"x" * 20 + b" one"
    bounds = np.array([0, 33, 33, len(raw)])
    words, row, term, tf = a.counts(np.frombuffer(raw, np.uint8), bounds)
    assert words.tolist() == [6, 0, 2] and sorted(zip(row.tolist(), term.tolist(), tf.tolist())) == [(0, 0, 3), (0, 1, 2), (0, 2, 1), (2, 0, 1)]


def test_best_keeps_ties_by_id():
    best = lexical.Best(2, 3)
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2)), int(rng.integers(1, 5)), int(rng.random() < 0.1), int(i)) for i in rng.permutation(30_000)]
    for i in range(0, len(rows), 500):
        best.add(*np.array([r for r in rows[i: i + 500] if r[1] >= best.floor[r[0]]], np.int64).reshape(-1, 4).T)
    best.cut()
    want = [r for k in range(2) for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2], r[3]))[:3]]
    assert sorted(map(tuple, best.rows.T.tolist())) == sorted(want)


def test_lexical_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.filter("text = ''"), items).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and the path (sibling or '', whether it stands left) of each node."""
    at, paths, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            q = p ^ 1
            paths[i].append((level[q] if q < len(level) else "", p % 2 == 1))
            at[i] = p // 2
        level = [H(*level[i: i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def plain_manifest(rows):
    def leaf(r, more=0):
        values = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    groups = defaultdict(list)
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r), leaf(r, int(hit)), r.doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: (sorted(groups[g], key=lambda x: x[:4]), *tree([x[2] for x in sorted(groups[g], key=lambda x: x[:4])])) for g in names}
    root, tops = tree([made[g][1] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        leaves, subroot, paths = made[g]
        for x, p in zip(leaves, paths, strict=True):
            h = x[3]
            for sibling, left in p + top:
                h = H(sibling, h) if left else H(h, sibling)
            out.append((x[4], x[2], subroot, root, H(*(s for s, _ in p + top)), h, h == root))
    return out


def manifest_of(docs):
    hit = F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0)
    changed = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return [tuple(r) for r in merkle.manifest(docs, "doc_id", "lang", changed=changed).drop("path").collect()]


def test_merkle_manifest(docs):
    got = manifest_of(docs)
    assert Counter(got) == Counter(plain_manifest(docs.collect()))
    assert {r[6] for r in got} == {True, False} and len({r[3] for r in got}) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 256, 257])
def test_merkle_manifest_of_n_rows(spark, n):
    rows = spark.range(n).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    assert Counter(manifest_of(rows)) == Counter(plain_manifest(rows.collect()) if n else [])


def test_merkle_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    monkeypatch.setattr(merkle, "_DEPTH", merkle._DEPTH.replace("8", "2"))
    rows = spark.range(150).selectExpr("id AS doc_id", "'t' AS text", "if(id % 3 > 0, 'a', concat('l', id % 27)) AS lang", "'s' AS source", "id AS n_chars")
    assert Counter(manifest_of(rows)) == Counter(plain_manifest(rows.collect()))


def plain_duplicates(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep, sha = max((i for i in ids if i is not None), default=None), H(text)
        kept = ids.index(keep)
        out += [(i, keep, len(ids), j == kept, sha) for j, i in enumerate(ids)]
    return out


@pytest.mark.parametrize("fits", [exact.FITS, 600])
def test_exact_duplicates(docs, fits):
    got = exact.exact_duplicates(docs, fits).collect()
    assert Counter(map(tuple, got)) == Counter(plain_duplicates(docs.collect()))


def test_exact_duplicates_of_many_records(docs, monkeypatch):
    """A text with more rows than a record or a table holds."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([3, None, 7, 1, 2]), "text": ["a"] * 4 + ["b"], "hash": [5, 5, 5, 5, 5]})
    monkeypatch.setattr(exact, "MOST_IDS", 3)
    monkeypatch.setattr(exact, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 2)}))}))
    rows = [r for b in exact._records(iter([batch])) for r in b.to_pylist()]
    assert [(r["record"] - (2 << 33), r["content"], r["ids"]) for r in rows] == [(0, b"a", [7, 3, None]), (1, b"a", [1]), (2, b"b", [2])]
    table = pa.RecordBatch.from_pydict({"bucket": [0] * 3, "record": [r["record"] for r in rows], "hash": [5] * 3, "content": [r["content"] for r in rows],
                                        "n": [len(r["ids"]) for r in rows], "best": [r["ids"][0] for r in rows]})
    done = [r for b in exact._decided(iter([table.slice(0, 2), table.slice(2)])) for r in b.to_pylist()]
    assert [(r["keep_id"], r["group_size"], r["keeper"]) for r in done] == [(7, 4, True), (7, 4, False), (2, 1, True)]  # one hash, two texts


def test_open_table_grows():
    held = exact.OpenTable(4)
    for again in range(2):
        assert [held.place(i % 3, str(i).encode()) for i in range(200)] == list(range(200)), again


def test_exact_duplicates_of_nothing(docs):
    assert exact.exact_duplicates(docs.limit(0)).count() == 0
