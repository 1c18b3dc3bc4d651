import duckdb

import corpus_pipeline
from trackframe.llm.mixing import targets


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.limit(5)).unionByName(
        spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "12 34", "en", None, 5)], docs.schema)
    )
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        sizes.append((name, docs.count()))
    assert [n for n, _ in sizes] == ["language ID", "SimHash near-dedup", "substring dedup", "source mix"]
    assert sizes[0][1] == 125 and sizes[1][1] <= 120
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == sizes[-1][1] and "ids_sha256" in last.columns


def test_run_against_its_stages_by_hand(spark, sf):
    """The documents that stay and how often, rebuilt from the operators' own results over plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    step = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, sf)
    kept = step.collect()
    assert len({x.doc_id for x in kept}) == len(kept)
    held = {}
    for x in kept:
        held[x.source] = held.get(x.source, 0) + len(x.text.encode().split())
    order = sorted(held)
    wanted = dict(zip(order, targets(sum(held.values()), [held[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    source = {x.doc_id: (x.source, len(x.text.encode().split())) for x in kept}
    taken = dict.fromkeys(order, 0)
    for x in out:
        taken[source[x.doc_id][0]] += source[x.doc_id][1]
    longest = max(n for _, n in source.values())
    assert all(abs(taken[s] - wanted[s]) <= longest for s in order)


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, sf)
    letters = duckdb.sql(f"select count(*) from '{sf}/documents.parquet' where regexp_matches(text, '\\p{{L}}')").fetchall()[0][0]
    assert kept.count() >= 0.99 * letters


CLASHES = ("_h1", "_h2", "n", "root", "copies", "copy", "kept", "fp", "key", "score", "lang_pred", "size", "_rid", "route", "ids", "_utf8")


def awkward(spark, words):
    """Rows with null and repeated ids; texts that are no near-duplicates of each other unless said."""
    texts = [words(60 + k, 100 + k, 2000) for k in range(30)]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, len(t)) for k, t in enumerate(texts[:20])]
    rows += [(None, texts[20], "en", "s0", 1), (None, texts[21], "en", "s0", 1), (None, texts[22], None, None, None)]
    rows += [(5, texts[23], "en", "s1", 1), (5, texts[24], "en", "s1", 1)]  # one id, other texts
    rows += [rows[3], rows[3], (None, texts[20], "en", "s0", 1)]  # equal in full
    rows += [(70, texts[4], "en", "s2", 9)]  # a copy of 4
    rows += [(71, words(30_000, 9, 3000), "en", "s0", 1)]
    nothing = [(80, None, "en", "s0", 0), (81, "", "en", "s0", 0), (82, " \n\t", "en", None, 3), (83, "12 34", None, "s1", 5)]
    df = spark.createDataFrame(rows + nothing, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        df = df.selectExpr("*", f"'x' as {name}")
    return rows, nothing, df


def by_row(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_language_stage_on_awkward_rows(spark, sf, words):
    rows, _, df = awkward(spark, words)
    assert by_row(corpus_pipeline.language_id(spark, df, sf).collect()) == by_row(rows)
    unlabelled = df.selectExpr("doc_id", "text", "string(null) as lang", "source", "n_chars")
    assert corpus_pipeline.language_id(spark, unlabelled, sf).count() == len(rows)


def test_near_dedup_loses_no_text(spark, sf, words):
    """Every text stays once, with the smallest id that has it, whatever the order of the rows."""
    rows, nothing, df = awkward(spark, words)
    expected = {}
    for r in rows:
        key = (r[0] is None, r[0])
        if r[1] not in expected or key < expected[r[1]]:
            expected[r[1]] = key
    first = corpus_pipeline.near_dedup(spark, df, sf).collect()
    again = corpus_pipeline.near_dedup(spark, df.repartition(7), sf).collect()
    assert by_row(first) == by_row(again)
    blank = [r for r in first if not (r.text or "").strip()]
    assert [r.doc_id for r in blank] == [80]
    got = [(r.text, (r.doc_id is None, r.doc_id)) for r in first if (r.text or "").strip() and r.text != "12 34"]
    assert sorted(got) == sorted(expected.items())


def test_substring_stage_on_awkward_rows(spark, sf, words):
    rows, nothing, df = awkward(spark, words)
    out = corpus_pipeline.substring_dedup(spark, df, sf).collect()
    # Only the copy of 4 and, of the rows that are equal in full, none: they have one id or none. All else stays as it is.
    expected = [r for r in rows + nothing if r[0] != 70]
    assert by_row(out) == by_row(expected)


def test_mix_counts_every_row(spark, sf, words):
    """Rows with one id, no id, or alike in full are taken each; the words taken come near each source's target."""
    rows, nothing, df = awkward(spark, words)
    out = corpus_pipeline.source_mix(spark, df, sf).collect()
    size = {r: len((r[1] or "").split()) for r in map(tuple, rows + nothing)}
    held, taken = {}, {}
    for r in rows + nothing:
        held[r[3]] = held.get(r[3], 0) + size[tuple(r)]
    times, there = {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + size[tuple(r)]
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    for r in map(tuple, rows + nothing):
        there[r] = there.get(r, 0) + 1
    assert all(times[r] <= 3 * there[r] for r in times)
    order = sorted(held, key=lambda s: (s is None, s or ""))
    wanted = targets(sum(held.values()), [held[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    for s, t in zip(order, wanted):
        assert abs(taken.get(s, 0) - t) <= max(n for r, n in size.items() if r[3] == s)
    full = [s for s, t in zip(order, wanted) if t >= held[s]]
    assert all(times.get(r, 0) >= there[r] for r in size if r[3] in full and size[r])


def test_bpe_stage_on_awkward_rows(spark, sf, words):
    rows, nothing, df = awkward(spark, words)
    out = corpus_pipeline.byte_bpe(spark, df, sf).collect()
    assert sorted(map(repr, (r.doc_id for r in out))) == sorted(repr(r[0]) for r in rows + nothing)
    assert all(r.n_tokens == 0 for r in out if r.doc_id in (80, 81))


def test_empty_table_in_every_stage(spark, sf, words):
    docs = awkward(spark, words)[2].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_one_after_another_on_awkward_rows(spark, sf, words):
    rows, _, docs = awkward(spark, words)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    kept = docs.collect()
    assert {r.text for r in kept} == {r[1] for r in rows}
