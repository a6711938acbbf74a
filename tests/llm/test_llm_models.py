"""Language id, quality and neighbours on held-out rows, and the pipeline against plain Python."""

import os
import zlib

import numpy as np
import pytest
from corpora import clashing, documents, edge_texts
from pyspark.sql import functions as F
from test_llm_groups import plain_groups, plain_hits
from test_llm_texts import WHITE, plain_line_dedup

import corpus_pipeline
from rillwatch.llm import language, neighbours, pieces, quality
from rillwatch.llm.common import fold, table

QUERY_DIR = os.environ.get("TEST_QUERY_DIR", "/root/testdata/sf0.01")


# ---------------------------------------------------------------- language id


def test_languages_of_held_out_documents(spark):
    known = {r.doc_id: r for r in table(spark, QUERY_DIR, "documents").collect()}
    rows = language.op5_language_id(spark, QUERY_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and known[r.doc_id].lang]
    right = np.mean([r.lang_pred == known[r.doc_id].lang for r in judged])
    assert right >= 0.97 and abs(np.mean([r.score for r in judged]) - right) < 0.05


def test_ngrams_stay_inside_their_text():
    alone, _ = language.ngram_codes(["abc"], 1 << 10)
    both, limits = language.ngram_codes(["abc", "xyz é"], 1 << 10)
    assert (both[: limits[1]] == alone).all() and limits[-1] == len(both)


def test_language_of_edge_cases(spark):
    docs = documents(spark, ["hello there my friend", "good day to you"], "en").union(
        documents(spark, [(5, "guten Tag mein Freund"), (6, "schönen Tag noch")], "de")
    )
    model = language.fit_language_model(docs, F.lit(True))
    assert model["languages"] == ["de", "en"]
    numerals = [(72, "½ ² ① Ⅷ 3"), (73, "½ ² ① Ⅷ 3 a"), (74, "²a")]
    odd = clashing(documents(spark, edge_texts() + [(70, "12345 !!"), (71, "my friend"), *numerals]))
    found = language.predict_language(F.col("text"), model, spark)
    rows = odd.select("text", found.alias("f")).select("text", "f.*").collect()
    for row in rows:
        lettered = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred == "und") == (not lettered) and 0 <= row.score <= 1
    assert language.keep_known_languages(odd, model).columns == odd.columns
    none = language.fit_language_model(docs, F.lit(False))
    found = language.predict_language(F.col("text"), none, spark)
    assert {r[0] for r in docs.select(found["lang_pred"]).collect()} == {"und"}
    assert language.keep_known_languages(docs.limit(0), model).count() == 0


def test_sample_is_bounded_where_doc_ids_lack_or_repeat(spark, monkeypatch):
    texts = [(None, f"hello my friend number {i}") for i in range(400)] + [(3, "good day to you")] * 300
    seen = []
    fit = language.FollowTheLeader.learn
    monkeypatch.setattr(language.FollowTheLeader, "learn", lambda self, rows, wanted: seen.append(len(rows)) or fit(self, rows, wanted))
    model = language.fit_language_model(documents(spark, texts), F.lit(True), per_language=50)
    assert model["languages"] == ["en"] and 10 <= sum(seen) / language.EPOCHS <= 100


def plain_leader(documents_, wanted, dimensions, classes):
    """Follow-the-regularised-leader by loops, one coordinate at a time, batch by batch."""
    z, n = np.zeros((dimensions + 1, classes)), np.zeros((dimensions + 1, classes))

    def weight(f, c):
        if abs(z[f, c]) <= language.L1:
            return 0.0
        rate = (language.BETA + np.sqrt(n[f, c])) / language.ALPHA + language.L2
        return -(z[f, c] - np.sign(z[f, c]) * language.L1) / rate

    for start in range(0, len(documents_), language.BATCH):
        some = list(zip(documents_, wanted))[start : start + language.BATCH]
        gradient = {}
        for (features, values), label in some:
            logits = [sum(weight(f, c) * v for f, v in zip(features, values)) for c in range(classes)]
            top = max(logits)
            chances = [np.exp(x - top) for x in logits]
            for c in range(classes):
                error = chances[c] / sum(chances) - (c == label)
                for f, v in zip(features, values):
                    gradient[f, c] = gradient.get((f, c), 0.0) + error * v / len(some)
        for (f, c), g in gradient.items():
            step = (np.sqrt(n[f, c] + g * g) - np.sqrt(n[f, c])) / language.ALPHA
            z[f, c] += g - step * weight(f, c)
            n[f, c] += g * g
    return np.array([[weight(f, c) for c in range(classes)] for f in range(dimensions + 1)])


def test_leader_learns_the_weights_of_plain_loops():
    rnd = np.random.default_rng(4)
    rows, wanted = [], rnd.integers(0, 3, 100)
    for label in wanted:
        features = np.unique(rnd.integers(0, 12, 4) + 4 * label)
        rows.append((np.append(features, 24), np.append(rnd.random(len(features)) * 3, 1.0)))
    model = language.FollowTheLeader(24, 3)
    for start in range(0, len(rows), language.BATCH):
        model.learn(rows[start : start + language.BATCH], wanted[start : start + language.BATCH])
    assert model.weights() == pytest.approx(plain_leader(rows, wanted, 24, 3), abs=1e-9)


def test_temperature_calms_a_model_that_is_too_sure():
    rnd = np.random.default_rng(0)
    wanted = rnd.integers(0, 2, 2000)
    logits = np.where(np.arange(2) == wanted[:, None], 1.0, 0.0) * 9.0
    wrong = rnd.random(2000) < 0.2
    logits[wrong] = logits[wrong][:, ::-1]
    assert language.fit_temperature(logits, wanted) == pytest.approx(9 / np.log(4), rel=0.15)


# ---------------------------------------------------------------- quality


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in table(spark, QUERY_DIR, "labels").collect()}
    rows = quality.op10_quality(spark, QUERY_DIR).collect()
    assert len(rows) == table(spark, QUERY_DIR, "documents").count()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
    judged = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in judged]) >= 0.95


def test_quality_of_edge_cases(spark):
    docs = clashing(documents(spark, edge_texts()))
    stats = quality.document_statistics(docs)
    assert all(len(r.stats) == len(quality.STATISTICS) and np.isfinite(r.stats).all() for r in stats.collect())
    labels = spark.createDataFrame([(7, 1, 0), (8, None, 0), (9, 5, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    for learns in (F.lit(True), F.lit(False)):
        trees = quality.fit_quality(stats, labels, learns)
        scores = [r[0] for r in stats.select(quality.quality_score(F.col("stats"), trees, spark)).collect()]
        assert len(scores) == len(edge_texts()) and all(0 <= s <= 1 for s in scores)
    assert quality.document_statistics(docs.limit(0)).count() == 0


def test_first_split_is_the_best_of_all():
    """The root of the first tree against a plain search over every feature and limit."""
    rnd = np.random.default_rng(6)
    data = rnd.integers(0, 12, (300, 4)).astype(float)
    labels = (data[:, 2] > 6).astype(float)
    labels[rnd.random(300) < 0.1] = 1.0
    trees = quality.BoostedTrees.fit(data, labels)
    error = labels - labels.mean()
    curve = np.full(300, labels.mean() * (1 - labels.mean()))

    def gain(rows):
        return error[rows].sum() ** 2 / (curve[rows].sum() + 1.0) if rows.any() else 0.0

    best = max(
        ((gain(data[:, f] <= v) + gain(data[:, f] > v), f, v) for f in range(4) for v in np.unique(data[:, f])[:-1]),
    )
    assert trees.feature[0][0] == best[1] == 2
    left = data[:, 2] <= trees.limit[0][0]
    assert gain(left) + gain(~left) == pytest.approx(best[0], rel=1e-6)


def test_trees_walk_as_they_were_grown():
    rnd = np.random.default_rng(2)
    data = rnd.normal(size=(600, 5))
    labels = ((data[:, 0] > 0) ^ (data[:, 3] > 0.5)).astype(float)
    trees = quality.BoostedTrees.fit(data, labels)
    assert ((trees.score(data) > 0.5) == labels).mean() > 0.97

    def walk(row):
        total = trees.start
        for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert trees.score(data[:50]) == pytest.approx([walk(r) for r in data[:50]])


# ---------------------------------------------------------------- neighbours


def plain_neighbours(vectors, queries, count):
    out = {}
    ids = np.array([i for i, _ in vectors])
    data = np.array([v for _, v in vectors])
    for q in queries:
        score = data @ data[np.flatnonzero(ids == q)[0]]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:count]
        out[q] = [(int(ids[k]), float(score[k])) for k in order]
    return out


def _found(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(out[row.query_id])
    return out


def test_query_recall(spark):
    vectors = [(r.vec_id, r.embedding) for r in table(spark, QUERY_DIR, "embeddings").collect()]
    wanted = plain_neighbours(vectors, [i for i, _ in vectors if i % 20 == 0], 20)
    got = _found(neighbours.op2_nearest_neighbours(spark, QUERY_DIR).collect())
    assert got.keys() == wanted.keys() and all(len(x) == 20 for x in got.values())
    exact = {q: dict(plain_neighbours(vectors, [q], len(vectors))[q]) for q in got}
    for q, some in got.items():
        assert [s for _, s in some] == sorted((s for _, s in some), reverse=True)
        assert all(score == pytest.approx(exact[q][i], abs=1e-12) for i, score in some)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in got)
    assert hits / (20 * len(got)) >= 0.9


def test_several_visits_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rnd = np.random.default_rng(5)
    data = rnd.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    vectors = list(enumerate(data.astype(np.float64)))
    wanted = plain_neighbours(vectors, range(0, 3000, 50), 10)
    got = _found(neighbours.nearest_neighbours(df, F.col("id") % 50 == 0, count=10, partitions=8).collect())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits / (10 * len(wanted)) >= 0.9


def test_large_partitions_are_sliced(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("SLICE_ROWS", 128), ("ASKED_ROWS", 32)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    rnd = np.random.default_rng(7)
    data = rnd.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    groups, paired = [], neighbours._paired

    def seen(*args):
        out = paired(*args)
        groups.extend(out[0].groupBy("part", "slice", "asked_slice").count().collect())
        return out

    monkeypatch.setattr(neighbours, "_paired", seen)
    got = _found(neighbours.nearest_neighbours(df, F.col("id") % 10 == 0, count=10, partitions=1).collect())
    wanted = plain_neighbours(list(enumerate(data)), range(0, 1500, 10), 10)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in wanted.items()}
    assert len(groups) > 30 and max(g["count"] for g in groups) < sum(g["count"] for g in groups) / 10


def test_vec_ids_that_repeat_hide_no_others(spark):
    rows = [(0, [1.0, 0.5])] * 30 + [(i, [1.0, 0.5]) for i in range(1, 6)] + [(50, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = _found(neighbours.nearest_neighbours(df, F.col("id").isin(0, 50)).collect())
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5, 50]
    assert [i for i, _ in got[50]] == [0] * 20


def test_products_beyond_doubles_are_ranked(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 0.0]), (2, [1.0, 0.0]), (3, [-1e200, 1.0]), (4, [1e200, 1e200]), (5, [1e200, -1e200])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = _found(neighbours.nearest_neighbours(df, F.col("id") < 6).collect())
    inf = float("inf")
    assert got[0] == [(1, inf), (4, inf), (5, inf), (2, 1e200), (3, -inf)]
    # infinite parts of both signs cancel to the lowest score
    assert [i for i, _ in got[4]] == [0, 1, 2, 3, 5] and got[4][-1] == (5, -inf)


def test_equal_vectors_have_equal_scores_in_any_block(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 37)
    rnd = np.random.default_rng(11)
    base = rnd.normal(size=(60, 33))
    data = np.concatenate([base] * 12)[rnd.permutation(720)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    got = _found(neighbours.nearest_neighbours(df, F.col("id") % 9 == 0, count=30, partitions=1).collect())
    for q, some in got.items():
        exact = neighbours.inner_products(np.repeat(data[q : q + 1], 720, axis=0), data)
        order = [k for k in np.lexsort((np.arange(720), -exact)) if k != q][:30]
        assert some == [(k, exact[k]) for k in order]


def test_vectors_of_each_length_are_searched(spark):
    rows = [(i, [float(i), 1.0]) for i in range(10)] + [(i, [float(i), 0.0, 2.0]) for i in range(10, 17)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = _found(neighbours.nearest_neighbours(df, F.col("id").isin(3, 12), count=4).collect())
    assert [i for i, _ in got[3]] == [9, 8, 7, 6] and [i for i, _ in got[12]] == [16, 15, 14, 13]


def test_neighbours_of_edge_cases(spark):
    bad = [None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0], []]
    rows = [(i, [1.0, 0.5]) for i in range(40)] + [(40 + i, v) for i, v in enumerate(bad)]
    rows += [(60, [2.0, 0.0]), (61, [-0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS vec", "1 AS part")
    got = _found(neighbours.nearest_neighbours(df, F.col("id").isin(0, 35, 40, 45, 60)).collect())
    assert got.keys() == {0, 35, 60}
    assert [i for i, _ in got[0]] == [60, *range(1, 20)] and [i for i, _ in got[35]] == [60, *range(19)]
    assert [i for i, _ in got[60]] == list(range(20))
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id bigint, embedding array<float>")
    assert _found(neighbours.nearest_neighbours(few, F.col("id") % 20 == 0).collect()) == {0: [(20, 2.0)], 20: [(0, 2.0)]}
    assert neighbours.nearest_neighbours(few.limit(0), F.lit(True)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_as_in_plain_python(spark):
    docs = table(spark, QUERY_DIR, "documents")
    model = language.fit_language_model(docs, fold(5) != 0)
    kept = [(r.doc_id, r.text) for r in language.keep_known_languages(docs, model).collect()]
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {i for i, _ in kept} == lettered
    kept = [
        (i, text)
        for (_, before), (i, _, _, text) in zip(kept, plain_line_dedup(kept))
        if text.strip(WHITE) or not (before or "").strip(WHITE)
    ]
    stay = {i for i, _, group in plain_groups(kept, 5, 8, 10) if i == group}
    kept = [(i, t) for i, t in kept if i in stay]
    items = [(r.item_id, r.text) for r in table(spark, QUERY_DIR, "benchmark").collect()]
    clean = {i for i, n, hit, _ in plain_hits(kept, items) if not (hit and 20 * len(hit) >= n)}
    coder = pieces.PieceModel(**pieces.read_model(pieces.model_file()))
    wanted = {
        i: np.frombuffer(coder.encode([t.encode()])[0], coder.kind).tolist() for i, t in kept if i in clean
    }
    rows = corpus_pipeline.run(spark, QUERY_DIR).collect()
    assert {r.doc_id: r.ids for r in rows} == wanted and all(r.round_trip and r.n_tokens for r in rows)


def test_stages_keep_their_columns(spark):
    docs = documents(spark, edge_texts())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, QUERY_DIR)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), QUERY_DIR).count() == 0
