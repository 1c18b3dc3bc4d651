import hashlib
import random
import re
import zlib

import zstandard

from trackframe.llm import media as m
from trackframe.llm.queries import op7_media_chunks


def test_wav_round_trip():
    for raw in (b"", b"x", b"a" * 64, bytes(range(256)) * 5):
        n, samples = m.from_wav(m.to_wav(raw))
        assert n == len(raw) and samples[:n] == raw and len(samples) % 64 == 0 and len(samples) >= 64
        assert not any(samples[n:])


def test_cuts_follow_the_content():
    r = random.Random(1)
    body = bytes(r.randrange(256) for _ in range(60_000))
    ends = m.cut_points(body)
    assert ends[-1] == len(body) and all(b - a <= 8192 for a, b in zip([0, *ends], ends))
    shifted = m.cut_points(b"some other beginning" + body)
    assert len({e + 20 for e in ends} & set(shifted)) > len(ends) * 0.8
    rolling, gear = 0, m.GEAR.tolist()
    marks = set()
    for k, b in enumerate(body):
        rolling = (rolling * 2 + gear[b]) % 2**32
        if rolling >> 21 == 0:
            marks.add(k + 1)
    assert all(e in marks or b - a == 8192 or e == len(body) for a, e, b in zip([0, *ends], ends, ends) if b - a != 8192)


def facts(docs):
    references, lists, chunks = m.store(docs)
    return references.join(m.media_facts(m.rebuild(lists, chunks)), "key").collect()


def test_whole_operator(make, words):
    base = words(8000, 1)
    texts = [None, "", "x", "é" * 50, base, base, words(50, 2) + " " + base, base + " " + words(90, 3), "a" * 100_000]
    texts += [words(3000, k) + base[10_000:30_000] for k in range(5, 9)]
    rows = facts(make(texts, extra=True))
    assert len(rows) == len(texts) and all(x.verified for x in rows)
    assert sum(x.n_fetched for x in rows) > 10
    for x in rows:
        raw = (texts[x.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (x.n_bytes, x.payload_bytes) == (len(raw), len(payload))
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert x.tail_crc32 == zlib.crc32(payload[-64:])
        assert x.media_bytes == len(m.to_wav(raw)) and x.media_sha256 == hashlib.sha256(m.to_wav(raw)).hexdigest()
    assert rows[0].feature and len({x.feature for x in rows if x.doc_id in (4, 5)}) == 1


def test_each_digest_has_one_owner(make, words):
    base = words(20_000, 1)
    rows = facts(make([base, words(10, 2) + " " + base]))
    fetched, total = sum(x.n_fetched for x in rows), sum(x.n_chunks for x in rows)
    assert fetched >= 0.4 * total


def test_empty_table_and_null_ids(make):
    assert facts(make([])) == []
    assert len(facts(make([(None, "a"), (None, None), (1, "a")]))) == 3


def corpus(words):
    base = words(20_000, 1)
    return [None, "", "x", base, base, words(10, 2) + " " + base, *(words(2000, k) + base[20_000:60_000] for k in range(4, 8)), "é" * 9000, "a" * 50_000]


def test_chunks_and_owners_against_brute_force(make, words):
    """Each digest is stored once, with the owner that plain Python finds, and the lists have no bytes."""
    texts = corpus(words)
    references, lists, chunks = m.store(make(texts, extra=True))
    assert not {"packed", "data", "text", "media"} & {*references.columns, *lists.columns}
    expected, owner, places = {}, {}, {}
    for raw in {(t or "").encode() for t in texts}:
        parts = m.chunks_of(raw)
        expected[m.key_of(raw)] = (len(raw), parts)
        for idx, c in enumerate(parts):
            places.setdefault(m.digest(c), []).append((m.key_of(raw), idx))
    owner = {d: min(p) for d, p in places.items()}
    rows = chunks.collect()
    assert len(rows) == len({bytes(x.digest) for x in rows}) == len(owner)
    unpack = zstandard.ZstdDecompressor()
    for x in rows:
        key, idx = owner[bytes(x.digest)]
        assert bytes(x.owner) == key and x.shared == (len(places[bytes(x.digest)]) > 1)
        assert unpack.decompress(bytes(x.data)) == expected[key][1][idx]
    stored = {bytes(x.key): x for x in lists.collect()}
    assert stored.keys() == expected.keys()
    for key, (n, parts) in expected.items():
        assert stored[key].n_bytes == n
        got = [(p.idx, p.size, bytes(p.digest), bytes(p.owner)) for p in stored[key].parts]
        assert got == [(k, len(c), m.digest(c), owner[m.digest(c)][0]) for k, c in enumerate(parts)]
    total = sum(len(c) for _, parts in expected.values() for c in parts)
    assert sum(len(unpack.decompress(bytes(x.data))) for x in rows) < 0.6 * total


def test_a_missing_or_damaged_chunk_is_noticed(make, words, spark, tmp_path):
    """From the two written tables; without one chunk just the values that list it are lost."""
    references, lists, chunks = m.store(make(corpus(words)))
    lists.write.parquet(f"{tmp_path}/media")
    chunks.write.parquet(f"{tmp_path}/chunks")
    lists, chunks = spark.read.parquet(f"{tmp_path}/media"), spark.read.parquet(f"{tmp_path}/chunks")
    assert all(x.verified for x in m.rebuild(lists, chunks).collect())
    whole = {bytes(x.key): x for x in lists.collect()}
    shared = bytes(chunks.where("shared").orderBy("digest").first().digest)
    single = bytes(chunks.where("not shared").orderBy("digest").first().digest)
    other = bytes(zstandard.compress(b"other", 3))
    for digest in (shared, single):
        users = {k for k, x in whole.items() if any(bytes(p.digest) == digest for p in x.parts)}
        gone = chunks.where(chunks.digest != digest)
        bad = spark.createDataFrame([(whole[min(users)].parts[0].owner, digest, digest == shared, other)], chunks.schema)
        for table in (gone, gone.unionByName(bad)):
            out = {bytes(x.key): x for x in m.rebuild(lists, table).collect()}
            assert {k for k, x in out.items() if not x.verified} == users and len(out) == len(whole)
            assert all((x.media is None) == (k in users) for k, x in out.items())
            assert m.media_facts(m.rebuild(lists, table)).where("media_sha256 is null").count() == len(users)


def test_query_against_brute_force(spark, words, tmp_path):
    texts = corpus(words)
    spark.createDataFrame([*enumerate(texts), (None, "x"), (3, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = op7_media_chunks(spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == len(texts) + 2 and all(x.verified for x in rows)
    expected = sorted(hashlib.sha256(m.padded((t or "").encode())).hexdigest() for t in [*texts, "x", "other"])
    assert sorted(x.payload_sha256 for x in rows) == expected
    by_payload = {}
    for x in rows:
        by_payload.setdefault(x.payload_sha256, set()).add((x.n_bytes, x.tail_crc32, x.media_sha256, x.feature))
    assert all(len(v) == 1 for v in by_payload.values())


def test_each_pass_over_the_texts_runs_once(spark, sf):
    """Lists are written before; in the plan that is left the texts are packed in one stage, which both joins read."""
    df = op7_media_chunks(spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"_pack\(", plan)) == 1, plan
