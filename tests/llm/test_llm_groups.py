"""Jaccard join, components, decontamination and sharding against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpora import clashing, documents, edge_texts, mixed_texts

from rillwatch.llm import components, decontaminate, sharding, shingle_join
from rillwatch.llm.common import numbered, table


def _ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("task_edges", [500_000, 20])
def test_components(spark, task_edges):
    rnd = random.Random(2)
    edges = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(55)] + [(i, i + 1) for i in range(100, 150)]
    edges += [(200, i) for i in range(201, 240)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    found = components.connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint"), task_edges=task_edges
    )
    got = {r.node: r.component for r in found.collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: groups.find(x) for x in linked}


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- Jaccard join


def plain_groups(found, size, num, den):
    """(doc_id, text) rows to (doc_id, set size, smallest doc_id of the group)."""
    sets = []
    for _, text in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", _ascii_lower(text or ""))
        if not words:
            sets.append(frozenset())
        elif len(words) < size:
            sets.append(frozenset([("short", *words)]))
        else:
            sets.append(frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)))
    groups = Groups()
    keys = [-(2**63) if i is None else i for i, _ in found]
    for x in range(len(found)):
        groups.find(keys[x])
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and den * len(a & b) >= num * len(a | b):
                groups.join(keys[x], keys[y])
    return [(i, len(s), groups.find(k)) for (i, _), s, k in zip(found, sets, keys)]


def _check_groups(df, size, num, den, **options):
    found = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = shingle_join.similar_groups(df, size, num, den, **options)
    got = [(r.doc_id, r.n_shingles, r.component) for r in got.collect()]
    assert Counter(got) == Counter(plain_groups(found, size, num, den))


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_groups_as_all_pairs_give_them(spark, size, num, den):
    _check_groups(documents(spark, mixed_texts(150)), size, num, den)


def test_groups_of_edge_cases(spark):
    _check_groups(clashing(documents(spark, edge_texts())), 3, 90, 100)
    empty = documents(spark, [])
    assert shingle_join.similar_groups(empty).count() == 0
    assert shingle_join.keep_one_of_each_group(empty).count() == 0


def _repeated_ids():
    """Rows that share a doc_id with different texts, or lack one, and a document with the smallest number."""
    rnd = random.Random(12)
    x, y, z, v, w = (" ".join(f"{c}{rnd.randrange(10**6)}" for _ in range(20)) for c in "xyzvw")
    found = [(3, x), (5, x), (5, y), (6, y), (5, ""), (8, z), (8, z + " more"), (9, v), (9, w), (10, w + " end")]
    return found + [(None, z), (None, v + " tail"), (None, "quite alone"), (-(2**63), "lowest of all"), (11, " ")]


def test_texts_of_one_doc_id_join_groups(spark):
    groups = shingle_join.similar_groups(documents(spark, _repeated_ids()), 3, 8, 10).collect()
    got = {(r.doc_id, r.component) for r in groups}
    low = -(2**63)
    assert got == {(3, 3), (5, 3), (6, 3), (8, 8), (9, 9), (10, 9), (None, 8), (None, 9), (None, low), (low, low), (11, 11)}
    kept = shingle_join.keep_one_of_each_group(documents(spark, _repeated_ids()), 3, 8, 10).collect()
    assert Counter(r.doc_id for r in kept) == Counter([3, 8, 8, 9, 9, None, low, 11])
    assert [r.text for r in kept if r.doc_id is None] == ["quite alone"]


def test_lists_of_many_tiles(spark):
    """Texts that share most words but link in small groups only."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    texts = []
    for group in range(25):
        own = base[:]
        for place in rnd.sample(range(30), 4):
            own[place] = f"g{group}x{place}"
        for _ in range(3):
            one = own[:]
            one[rnd.randrange(30)] = f"r{rnd.randrange(10**6)}"
            texts.append(" ".join(one))
    rnd.shuffle(texts)
    _check_groups(documents(spark, texts).repartition(5), 1, 8, 10, tile=4)


def test_bitmaps_never_bound_too_low():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rnd.integers(0, 1000, rnd.integers(1, 900)).astype(np.uint64))
        b = np.unique(rnd.integers(0, 1000, rnd.integers(1, 900)).astype(np.uint64))
        maps = shingle_join.Bitmaps([shingle_join._bitmap(shingle_join._mixed(x)) for x in (a, b)])
        bound = maps.bound(np.array([len(a), len(b)]), np.array([0]), np.array([1]))
        assert bound[0] >= len(np.intersect1d(a, b))


def test_one_of_each_group_stays(spark):
    docs = clashing(documents(spark, mixed_texts(80)))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = sorted({g for _, _, g in plain_groups(rows, 5, 8, 10)})
    out = shingle_join.keep_one_of_each_group(docs)
    assert sorted(r.doc_id for r in out.collect()) == wanted and out.columns == docs.columns


def test_query_groups(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = [tuple(r) for r in shingle_join.op7_jaccard_join(spark, sf_dir).collect()]
    assert Counter(got) == Counter(plain_groups(rows, 3, 90, 100))


# ---------------------------------------------------------------- decontamination


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _ascii_lower(text or ""))


def plain_hits(docs, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        words = _words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[i : i + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words, hit, found = _words(text), set(), set()
        for length in lengths:
            for i in range(len(words) - length + 1):
                items_ = windows.get(tuple(words[i : i + length]))
                if items_:
                    hit.update(range(i + 1, i + length + 1))
                    found |= items_
        out.append((doc_id, len(words), tuple(sorted(hit)), tuple(sorted(found))))
    return out


def _contaminated_texts():
    rnd = random.Random(6)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate([1, 2, 5, 13, 14, 30, 40])]
    items += [(7, None), (8, "..."), (9, items[5][1].upper()), (10, "ÉCOLE Straße 12")]
    texts = []
    for _ in range(60):
        parts = [" ".join(f"d{rnd.randrange(50)}" for _ in range(rnd.randint(0, 60)))]
        for _ in range(rnd.randint(0, 3)):
            words = (rnd.choice(items)[1] or "x").split(" ")
            start = rnd.randint(0, 2)
            parts.append(rnd.choice([", ", " ", "--"]).join(words[start:]))
        rnd.shuffle(parts)
        texts.append("! ".join(parts))
    return texts + edge_texts(), items


@pytest.mark.parametrize("limits", [{}, {"max_set": 3}, {"max_set": 3, "max_broadcast": 3}])
def test_hits_as_in_plain_python(spark, limits):
    texts, items = _contaminated_texts()
    docs = clashing(documents(spark, [(t[0] + 100 if t[0] is not None else None, t[1]) if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.benchmark_hits(docs, bench, **limits)
    got = [(r.doc_id, r.n_words, tuple(sorted(r.places)), tuple(r["items"])) for r in found.collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(got) == Counter(plain_hits(rows, items))


def test_a_large_benchmark_moves_no_texts(spark, monkeypatch):
    """200,000 windows: hits are found through a broadcast table, and documents marked through another."""
    items = [(i, " ".join(f"w{i * 1012 + j}" for j in range(1012))) for i in range(200)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = ["own words only " * 9, "before " + " ".join(items[17][1].split(" ")[40:60]) + " behind", None]
    plans = []

    def seen(df, purpose):
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, purpose)

    store = decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", seen)
    rows = decontaminate.benchmark_hits(documents(spark, texts), bench).collect()
    assert {r.doc_id: (r.n_words, len(r.places), r["items"][:1]) for r in rows} == {
        0: (27, 0, []), 1: (22, 20, ["17"]), 2: (0, 0, []),
    }
    plans = dict(plans)
    assert plans["benchmark-places"].count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plans["benchmark-places"]
    assert "BroadcastHashJoin" in plans["benchmark-candidates"] and "Exchange hash" not in plans["benchmark-candidates"]


def test_contaminated_documents_leave(spark):
    texts, items = _contaminated_texts()
    docs = clashing(documents(spark, texts[:60]))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = {i for i, n, hit, _ in plain_hits(list(enumerate(texts[:60])), items) if not (hit and 20 * len(hit) >= n)}
    out = decontaminate.decontaminate(docs, bench)
    assert {r.doc_id for r in out.collect()} == wanted and out.columns == docs.columns
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 60
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    docs = documents(spark, ["one, Alpha-beta  GAMMA! two", "alpha beta", None, "alpha beta gamma"])
    out = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(docs, bench, cut=True).collect()}
    assert out == {0: ("one two"[:3] + "! two", 8), 1: ("alpha beta", 10), 2: (None, None), 3: ("", 0)}


# ---------------------------------------------------------------- sharding


def test_numbers_have_no_gaps(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id AS v")
    got = defaultdict(list)
    for row in numbered(df, ["k"], ["v"], "at", chunks=7).collect():
        got[row.k].append(row.at)
    assert all(sorted(x) == list(range(len(x))) for x in got.values()) and len(got) == 3


def test_chunks_grow_with_the_rows(spark, monkeypatch):
    from rillwatch.llm import common

    monkeypatch.setattr(common, "CHUNK_ROWS", 1)
    rows = numbered(spark.range(1000).selectExpr("id AS v"), [], ["v"], "at")
    assert sorted(r.at for r in rows.collect()) == list(range(1000))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "1000)" in plan


def test_tables_of_earlier_rounds_go(spark):
    from rillwatch.session import shared_folder, subfolders

    edges = [(i, i + 1) for i in range(60)]
    before = set(subfolders(spark, shared_folder(spark)))
    found = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), task_edges=10)
    assert found.count() == 61
    left = [n.rsplit("-", 1)[0] for n in set(subfolders(spark, shared_folder(spark))) - before]
    assert sorted(left) == ["all-edges", "edges", "large-star-edges"]


def _check_shards(rows, shards):
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for shard in sizes:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    return counts


def test_copies_share_a_shard(spark):
    texts = [f"text {i // 3}" for i in range(150)] + [f"single {i}" for i in range(250)]
    rows = sharding.shard_documents(clashing(documents(spark, texts)), shards=8).collect()
    _check_shards(rows, 8)
    where = defaultdict(set)
    for row in rows:
        where[texts[row.doc_id]].add(row.shard)
        assert row.size == len(texts[row.doc_id]) + 1 and row.text_crc32 == zlib.crc32(texts[row.doc_id].encode())
    assert all(len(s) == 1 for s in where.values())


def test_large_group_is_split_into_few_shards(spark):
    texts = ["the same"] * 200 + [f"pair {i // 2}" for i in range(100)] + [f"single {i}" for i in range(300)]
    rows = sharding.shard_documents(documents(spark, texts), shards=8).collect()
    _check_shards(rows, 8)
    held = Counter(r.shard for r in rows if texts[r.doc_id] == "the same")
    assert len(held) <= 4
    where = defaultdict(set)
    for row in rows:
        where[texts[row.doc_id]].add(row.shard)
    assert sum(len(s) > 1 for t, s in where.items() if t.startswith("pair")) <= 5


@pytest.mark.parametrize("copies,cut", [(2, 3), (3, 20)])
def test_full_shards_exchange_copies(spark, copies, cut):
    """Every document has copies, so no shard has a free place from the start."""
    texts = [f"text {i // copies}" for i in range(480)]
    rows = sharding.shard_documents(documents(spark, texts), shards=8).collect()
    _check_shards(rows, 8)
    where = defaultdict(set)
    for row in rows:
        where[texts[row.doc_id]].add(row.shard)
    assert sum(len(s) > 1 for s in where.values()) <= cut


def test_moves_go_along_cycles():
    wanted = np.array([[0, 5, 0], [0, 0, 4], [3, 0, 0]])
    assert sharding._flows(wanted, np.array([0, 0, 0])).tolist() == [[0, 3, 0], [0, 0, 3], [3, 0, 0]]
    assert sharding._flows(wanted, np.array([0, 1, 2])).tolist() == [[0, 5, 0], [0, 0, 4], [3, 0, 0]]


def test_shards_of_edge_cases(spark):
    rows = sharding.shard_documents(documents(spark, edge_texts()), shards=4).collect()
    _check_shards(rows, 4)
    assert sharding.shard_documents(documents(spark, []), shards=4).count() == 0
    copies = sharding.shard_documents(documents(spark, ["all alike"] * 33), shards=4).collect()
    _check_shards(copies, 4)


def test_query_sharding(spark, sf_dir):
    rows = sharding.op4_sharding(spark, sf_dir).collect()
    _check_shards(rows, 16)
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for row in rows:
        raw = (texts.pop(row.doc_id) or "").encode()
        assert (row.size, row.text_crc32, row.law) == (len(raw) + 1, zlib.crc32(raw), "rows")
    assert not texts


def test_query_decontamination_digest(spark, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    wanted = Counter(
        (i, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n)
        for i, n, hit, found in plain_hits(rows, items)
    )
    assert Counter(tuple(r) for r in decontaminate.op8_decontamination(spark, sf_dir).collect()) == wanted
