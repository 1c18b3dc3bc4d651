import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trackframe.llm import bpe
from trackframe.llm.queries import bpe_digests, op4_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def lists(made):
    """Ids of each text, from what encode returns."""
    ids, ends = made
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_same_ids_as_the_library(texts):
    own = bpe.vocabulary(PATH, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = lists(own.encode(texts))
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(i) for i in ids] == [t.encode() for t in texts]


def test_merges_that_lower_the_rank():
    """A made-up vocabulary in which a merge makes a pair of a lower rank than its own."""
    ranks = {bytes([b]): b for b in range(256)}
    for k, token in enumerate((b"abc", b"bc", b"ab", b"cab", b"abcab", b"aa", b"aaa", b"ba")):
        ranks[token] = 300 + k
    own = bpe.Vocabulary(ranks, r"[a-z]+|.")
    library = tiktoken.Encoding("t", pat_str=r"[a-z]+|.", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(30))) for _ in range(500)]
    assert lists(own.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_digests_of_awkward_texts(make, library, words):
    texts = [None, "", "<|endoftext|>", "a" * 3000, " " * 500, "né 👍‍ 中文\n\n\t x", words(20_000, 1), "x", "x"]
    out = bpe_digests(make(texts, extra=True)).collect()
    assert len(out) == len(texts)
    for row in out:
        ids = library.encode_ordinary(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()


def test_empty_table_null_ids_and_null_lists(make, spark):
    assert bpe_digests(make([])).count() == 0
    assert bpe_digests(make([(None, "a"), (None, "a")])).count() == 2
    rows = spark.createDataFrame([(1, None), (2, [64, 65])], "doc_id long, ids array<int>")
    out = {x.doc_id: bytes(x.decoded) for x in bpe.decode_documents(rows, PATH, P.PATTERN).collect()}
    assert out[1] == b"" and len(out[2]) == 2


def test_blocks_and_a_full_store(monkeypatch, library, words):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    own = bpe.Vocabulary(bpe.read_ranks(PATH), P.PATTERN)
    for seed in range(5):
        texts = [words(100, seed), words(50, seed + 50)]
        assert lists(own.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_blocks_buckets_and_plan(spark, make, library, words, monkeypatch):
    """Many small blocks that share pieces give what one gives; the texts are cut in one stage, and documents and pieces share an exchange."""
    texts = [words(r, 3, 60) if r % 7 else None for r in range(120)] + ["", "long " * 4000]
    docs = make(texts).repartition(5)
    for chars in (200, 1 << 24):
        monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)  # workers start from this process, so they see it only if forked anew
        df = bpe.encode_documents(docs, PATH, P.PATTERN)
        out = {x.doc_id: x.ids for x in df.collect()}
        assert len(out) == len(texts)
        assert all(out[k] == library.encode_ordinary(t or "") for k, t in enumerate(texts))
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("run(doc_id") == 1, plan


def test_one_process_in_blocks(library, words):
    """Split, replay and assemble by hand, over blocks whose lists are replayed together."""
    texts = [words(200, k, 300) for k in range(12)] + ["", "né 👍"]
    split, replay = bpe._split(PATH, P.PATTERN, 16), bpe._replay(PATH, P.PATTERN)
    rows = []
    for first in range(0, len(texts), 5):
        part = texts[first : first + 5]
        batch = bpe.pa.RecordBatch.from_arrays([bpe.pa.array(range(first, first + len(part))), bpe.pa.array([t.encode() for t in part])], names=["doc_id", "text"])
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(bpe, "TaskContext", type("T", (), {"get": staticmethod(lambda f=first: type("C", (), {"partitionId": lambda self: f})())}))
            rows += split(iter([batch]))
    table = bpe.pa.Table.from_batches(rows)
    pieces = table.filter(bpe.pc.equal(table["kind"], bpe.PIECES))
    seen = [p for data in pieces["data"].to_pylist() for p in bpe.unpack_pieces(data)]
    assert len(seen) > len(set(seen))  # blocks share pieces
    made = bpe.pa.Table.from_batches(list(replay(iter(table.sort_by("route").to_batches()))))
    out = {}
    for block in set(table["block"].drop_null().to_pylist()):
        own = table.filter(bpe.pc.equal(table["route"], block))
        got = bpe._assemble(own, made.filter(bpe.pc.equal(made["route"], block)))
        out |= dict(zip(got["doc_id"].to_pylist(), got["ids"].to_pylist()))
    assert [out[k] for k in range(len(texts))] == [library.encode_ordinary(t) for t in texts]
    with pytest.raises(ValueError, match="two ways"):  # as many pieces, but of another reading of the block
        right = made.filter(bpe.pc.equal(made["route"], block))
        at = right.column_names.index("digest")
        bpe._assemble(own, right.set_column(at, "digest", bpe.pc.add(right["digest"], 1)))


def test_digest_of_a_block():
    pieces = [b"ab", b"c", b"", b"de"]
    others = [pieces[::-1], [b"a", b"bc", b"", b"de"], pieces[:-1], [b"abc", b"", b"de"], []]
    assert bpe.block_digest(pieces) == bpe.block_digest(list(pieces))
    assert len({bpe.block_digest(p) for p in [pieces, *others]}) == 6


def test_query_against_the_library(spark, sf, library):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op4_bpe(spark, sf).collect()
    assert len(out) == len(docs)
    for row in out:
        ids = library.encode_ordinary(docs[row.doc_id] or "")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((docs[row.doc_id] or "").encode()).hexdigest()
