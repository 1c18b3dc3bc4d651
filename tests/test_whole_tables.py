"""Queries that take whole tables: every row is in the result, none is left out by its id or its angle."""

import duckdb

from trackframe.catalog import QUERIES
from trackframe.operators import aggregates, search


def count(sf, sql):
    return duckdb.sql(sql.replace("{sf}", sf)).fetchall()[0][0]


def test_every_row_is_an_anchor(spark, sf):
    n = count(sf, "select count(*) from '{sf}/embeddings.parquet'")
    losses, triplets = (QUERIES[q](spark, sf).collect() for q in ("nt_xent_batches", "hard_triplets_batches"))
    assert len({r.anchor for r in losses}) == len(losses) == n
    assert len({r.anchor for r in triplets}) == len(triplets) == n
    one = aggregates.contrastive(spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 128"), "vec_id", "label", "embedding")
    first = {r.anchor: r for r in one.collect() if r.positives}
    assert first.keys() == {r.anchor for r in losses if r.anchor < 128}
    assert all(first[r.anchor].positives == r.positives and abs(first[r.anchor].loss - r.loss) < 1e-5 for r in losses if r.anchor < 128)


def test_every_order_and_order_line(spark, sf):
    orders, lines = (count(sf, f"select count(*) from '{{sf}}/{t}.parquet'") for t in ("orders", "lineitem"))
    assert QUERIES["fk_chain_all"](spark, sf).select("o_orderkey").distinct().count() == orders > 201
    for name in ("quat_roundtrip_all", "rot6d_roundtrip_all"):
        assert QUERIES[name](spark, sf).count() == lines
    half = QUERIES["rot6d_roundtrip_all"](spark, sf).where("abs(w) <= 0.001").collect()
    assert half and all(abs(r.w**2 + r.x**2 + r.y**2 + r.z**2 - 1) < 1e-5 for r in half)
    assert all(next(v for v in (r.w, r.x, r.y, r.z) if abs(v) > 1e-5) > 0 for r in half)
    turned = QUERIES["quat_roundtrip_all"](spark, sf)
    assert turned.where("x <= -180 or z <= -180").isEmpty() and not turned.where("x = 180").isEmpty()


def test_queries_in_blocks(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = df.where("vec_id % 5 = 0").selectExpr("vec_id as query_id", "embedding")
    queries = queries.unionByName(queries.where("query_id = 0"))
    whole = search.knn_join(queries, df, 4, "query_id", "vec_id", "embedding")
    parts = search.knn_join(queries, df, 4, "query_id", "vec_id", "embedding", max_queries=30)
    assert [b.count() <= 30 for b in search.in_blocks(queries, 30)].count(True) >= 4
    assert sum(b.count() for b in search.in_blocks(queries, 30)) == queries.count() == 101
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and parts.count() == 400


def test_one_query_is_as_many(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as e")
    one = list(df.where("vec_id = 50").first().e)
    for name, found in (
        ("knn_l2_join", search.knn(df, one, 10, "vec_id", "e", "euclidean")),
        ("knn_threshold_join", search.knn(df, one, 50, "vec_id", "e", "euclidean", 1.2)),
        ("nearest_style_join", search.nearest(df.where("vec_id <> 50"), one, "vec_id", "e")),
    ):
        many = QUERIES[name](spark, sf).where("query_id = 50").collect()
        assert sorted((r.vec_id, r.distance) for r in many) == sorted((r.vec_id, round(r.distance, 6)) for r in found.collect())
    cosine = search.knn(df.where("vec_id <> 50"), one, 5, "vec_id", "e").collect()
    many = QUERIES["knn_join"](spark, sf).where("query_id = 50").orderBy("rank").collect()
    assert [r.vec_id for r in many] == [r.vec_id for r in cosine]


def test_index_recall_with_fewer_probes_than_cells(spark, sf):
    found = QUERIES["index_search"](spark, sf).collect()
    n = count(sf, "select count(*) from '{sf}/embeddings.parquet' where vec_id % 50 = 0")
    assert len({r.query_id for r in found}) == n and len(found) == 10 * n
    near = {(r.query_id, r.vec_id) for r in found}
    exact = {(r.query_id, r.vec_id) for r in QUERIES["knn_join"](spark, sf).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = search.VectorIndex.build(df, "vec_id", "embedding", cells=search.VectorIndex.CELLS)
    cells = index.centroids.count()
    assert cells > 3 * cells // 4 >= 1
    one = index.search_join(df.where("vec_id = 50").selectExpr("vec_id as q", "embedding"), "q", 10, 3).orderBy("rank").collect()
    assert [r.vec_id for r in one] == [r.vec_id for r in index.search(df.where("vec_id = 50").first().embedding, 10, 3).collect()]


def test_one_document_of_each_group_whatever_its_id(spark, sf):
    import corpus_pipeline

    text = {k: " ".join(f"{k}{j}" for j in range(40)) for k in "abcdefg"}
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "d"), (None, "d"), (None, "e"), (5, "f"), (None, "f"), (6, "f"), (7, "g")]
    docs = spark.createDataFrame([(k, text[t], "en", "s", len(text[t])) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (None, "e"), (5, "f"), (7, "g")], key=str)
    for part in (1, 3):
        kept = corpus_pipeline.near_dedup(spark, docs.repartition(part), sf)
        assert sorted(((r.doc_id, r.text[0]) for r in kept.collect()), key=str) == want
    mixed = corpus_pipeline.source_mix(spark, kept, sf).collect()
    assert sorted(((r.doc_id, r.text[0]) for r in mixed), key=str) == want
    one = docs.where("text like 'c%'")  # a single null id took every null id along
    assert corpus_pipeline.near_dedup(spark, one.unionByName(docs.where("doc_id is null and text like 'f%'")).unionByName(docs.where("doc_id = 5")), sf).count() == 2


def test_every_event_is_a_frame(spark, sf):
    n, users = (count(sf, f"select count({c}) from '{{sf}}/events.parquet'") for c in ("*", "distinct user_id"))
    made = QUERIES["skeleton_quality"](spark, sf).collect()
    assert sum(r.n_frames for r in made) == n and len(made) == users
    exported = QUERIES["bvh_export"](spark, sf).collect()
    assert sum(r.n_frames for r in exported) == n and all(r.bvh.count("JOINT") == 21 for r in exported)


def test_index_search_by_blocks(spark, sf):
    """Scores and ties are those of a sum over all pairs, whatever the block, and no join of rows with queries makes the pairs."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as e")
    df = df.unionByName(df.selectExpr("vec_id + 100000 as vec_id", "e")).repartition(3)  # copies: ties that the key decides
    odd = spark.createDataFrame([(900001, None), (900002, [1.0]), (900003, [None] * 64)], "vec_id long, e array<double>")
    queries = df.where("vec_id % 50 = 0").selectExpr("vec_id as q", "e")
    for cells in (None, 20):
        index = search.VectorIndex.build(df.unionByName(odd), "vec_id", "e", cells=cells)
        found = index.search_join(queries, "q", 7)
        assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()
        got = {(r.q, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
        blocks = index.search_join(queries, "q", 7, max_queries=9)
        assert got == {(r.q, r["rank"]): (r.vec_id, r.score) for r in blocks.collect()}
        assert len(got) == 7 * queries.count()
        for q in queries.where("q = 50").collect():
            one = index.search(list(q.e), 7).collect()
            assert [got[q.q, r["rank"]] for r in one] == [(r.vec_id, r.score) for r in one]


def test_nearest_centroid_is_that_of_the_plain_sum(spark):
    from trackframe.operators import clustering

    near = spark.createDataFrame([(0, [0.1, 0.3]), (1, [0.1, 0.3]), (2, [0.3, 0.1]), (7, [5.0, 5.0])], "cluster int, centroid array<double>")
    rows = [(1, [0.1, 0.3]), (2, [0.2, 0.2]), (3, [4.0, 9.0]), (4, None), (5, [1.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "k int, e array<double>")
    got = {r.k: r.cluster for r in clustering.assigned(df, near, "e").collect()}
    assert got == {1: 0, 2: 0, 3: 7, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}


def test_labels_are_written_before_segments_use_them_twice(spark, sf, monkeypatch):
    from trackframe.catalog import skeletons
    from trackframe.plans import match, signals
    from trackframe.plans.config import Config

    seen, plain = [], match.segment
    monkeypatch.setattr(match, "segment", lambda labelled, *a: seen.append(labelled) or plain(labelled, *a))
    off = signals.SignalConfig(False, False, False, False, False)
    _, found, _ = match.build(skeletons.frames(spark, sf).where("track_id < 3"), Config(signal=off, segment_before_canonical=True))
    assert found.count() > 0 and "Window" not in seen[0]._jdf.queryExecution().toString()
