import random

import numpy as np
import pytest
import xxhash

from trackframe.llm import simhash
from trackframe.llm.components import connected_components, stars


def brute_fingerprint(text):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=4):
    ids, parent = sorted(fps), {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_whole_operator_against_brute_force(make, words):
    r = random.Random(3)
    texts = [None, "", " ", "One two", "one TWO", "one two three four", "É é", words(20_000, 9)]
    for g in range(12):
        base = words(300, g).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[-1]] * 5
    rows = simhash.near_duplicates(make(texts, extra=True)).collect()
    fps = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    expected = components(fps)
    assert {x.doc_id: x.fingerprint for x in rows} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {x.doc_id: x.component_id for x in rows} == expected
    assert len(rows) == len(texts)


@pytest.mark.parametrize("plans", [simhash.PLANS, ((0, (32, 32), 5),)])
def test_no_link_is_missed(spark, plans):
    r = random.Random(4)
    fps = {}
    for _ in range(150):
        a = r.getrandbits(64)
        fps[len(fps)] = a
        for flips in (1, 2, 3, 4, 5):
            b = a
            for k in r.sample(range(64), flips):
                b ^= 1 << k
            fps[len(fps)] = b
    signed = [(int(np.uint64(v).view(np.int64)),) for v in set(fps.values())]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), plans=plans)
    found = connected_components(links)
    root = {int(np.int64(x.node).view(np.uint64)): x.root for x in found.collect()}
    expected = components(fps)
    for a in fps:
        for b in fps:
            if a < b:
                same = expected[a] == expected[b]
                va, vb = fps[a], fps[b]
                assert same == (va == vb or (va in root and vb in root and root[va] == root[vb]))


def test_dense_run_gives_a_tree():
    r = np.random.default_rng(5)
    fp = np.unique(np.array([sum(1 << int(b) for b in r.choice(64, k, False)) for k in r.integers(0, 4, 3000)], np.uint64))
    a, b = simhash.link_run(fp, np.ones(len(fp), bool), 4)
    assert len(a) < len(fp) and (np.bitwise_count(a ^ b) <= 4).all()
    names, roots = stars(a, b)
    label = dict(zip(names.tolist(), roots.tolist()))
    expected = components({int(f): int(f) for f in fp[:300]})
    for x in fp[:300].tolist():  # links within the first 300 hold in the whole as well
        assert label.get(x, x) == label.get(expected[x], expected[x])


def test_anchors_are_complete():
    """Codewords have syndrome 0, every home is within 1, and every anchor within reach is listed once."""
    block = simhash.plan_blocks(10, 4)[1]
    fp = np.random.default_rng(6).integers(0, 2**63, 50).astype(np.uint64)
    keys, owners = simhash.replicate(fp, [block])
    anchors = keys & np.uint64((1 << 40) - 1)
    assert (block.syndrome(anchors) == 0).all()
    assert (np.bitwise_count(anchors ^ block.value(owners)) <= block.reach).all()
    assert len(set(zip(keys.tolist(), owners.tolist()))) == len(keys)
    value = int(block.value(fp[:1])[0])
    near = [value] + [value ^ 1 << a for a in range(block.width)]
    near += [x ^ 1 << b for x in near[1:] for b in range(block.width)]
    near = np.unique(np.array(near, np.uint64))
    assert (block.syndrome(near) == 0).sum() == (owners == fp[0]).sum()


def test_components_of_a_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(200)]
    hub = [(1000, 1000 + k) for k in range(1, 300)]
    out = connected_components(spark.createDataFrame([*path, *hub, (5, 5)], "a long, b long")).collect()
    assert {x.root for x in out if x.node <= 200} == {0} and {x.root for x in out if x.node >= 1000} == {1000}
    assert len(out) == 201 + 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids_and_empty_table(make):
    assert simhash.near_duplicates(make([])).count() == 0
    rows = simhash.near_duplicates(make([(None, "a b c d e"), (7, "a b c d e"), (None, "z y x w v"), (7, "a b c d e")])).collect()
    assert sorted((x.doc_id is None, x.component_id) for x in rows if x.component_id) == [(False, 7), (False, 7), (True, 7)]
    assert [x.component_id for x in rows].count(None) == 1
