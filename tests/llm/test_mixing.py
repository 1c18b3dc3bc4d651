from fractions import Fraction
from itertools import product

import pytest

from trackframe.llm import mixing
from trackframe.llm.mixing import mix, route, targets


def test_targets_are_capped_and_the_excess_is_shared():
    assert targets(100, [50, 50], [1, 1]) == [50, 50]
    assert targets(100, [5, 95], [5, 2]) == [15, 85]
    assert targets(111, [1, 10, 100], [5, 2, 1]) == [3, 30, 78]
    assert targets(0, [0, 0], [5, 2]) == [0, 0]
    assert sum(targets(1000, [1, 2, 3, 994], [5, 2, 1, 5])) == 1000


def cost_of(flow, capacity):
    total = 0
    for row, c in zip(flow, capacity):
        passes, rest = divmod(sum(row), c) if c else (0, 0)
        total += sum(k * c for k in range(passes)) + passes * rest
    return total


@pytest.mark.parametrize(
    "capacity, members, quota",
    [
        ([2, 1], [[0], [0, 1]], [3, 2]),
        ([1, 2], [[0, 1], [1]], [2, 3]),
        ([1, 1, 1], [[0, 1], [1, 2], [0, 2]], [2, 3, 1]),
        ([2, 0, 1], [[0], [1], [0, 1]], [4, 2]),
    ],
)
def test_flow_against_all_flows(capacity, members, quota):
    flow = route(capacity, members, quota)
    best = None
    arcs = [(p, s) for p, m in enumerate(members) for s in m]
    for values in product(range(7), repeat=len(arcs)):
        used, got = [0] * len(capacity), [0] * len(quota)
        for (p, s), v in zip(arcs, values):
            used[p] += v
            got[s] += v
        if all(u <= 3 * c for u, c in zip(used, capacity)) and all(g <= q for g, q in zip(got, quota)):
            rows = [[0] * len(quota) for _ in capacity]
            for (p, s), v in zip(arcs, values):
                rows[p][s] = v
            key = (-sum(values), cost_of(rows, capacity))
            best = key if best is None else min(best, key)
    assert (-sum(map(sum, flow)), cost_of(flow, capacity)) == best
    assert all(sum(f) <= 3 * c for f, c in zip(flow, capacity))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_contract(spark, words):
    rows = [(k, words(5 + k * 7 % 60, k), ["a", "b", "c", "é", None][k % 5] if k % 9 else "a") for k in range(900)]
    rows += [(900, None, "b"), (901, "", "c"), (902, " \n", "b")]
    df = documents(spark, rows).selectExpr("*", "1 as size", "'x' as key", "2 as copies", "3 as given")
    out = mix(df).collect()
    assert len(out) == len(rows)
    sizes = {k: len((t or "").split()) for k, t, _ in rows}
    held = {}
    for k, _, s in rows:
        held[s] = held.get(s, 0) + sizes[k]
    order = sorted(held, key=lambda s: (s is None, s or ""))
    expected = dict(zip(order, targets(sum(held.values()), [held[s] for s in order], [5, 2, 1, 5, 2])))
    taken = dict.fromkeys(order, 0)
    for x in out:
        assert x["size"] == sizes[x.doc_id] and 0 <= x.taken <= 3 * x["size"] and x.taken == x.copies * x["size"]
        assert x.source_size == held[x.source] and x.target == float(expected[x.source])
        taken[x.source] += x.taken
    for s in order:
        assert abs(taken[s] - expected[s]) <= 1 + max(sizes.values()) / 2
    again = {x.doc_id: x.taken for x in mix(df.repartition(7)).collect()}
    assert again == {x.doc_id: x.taken for x in out}
    assert {x.doc_id: x.taken for x in mix(df, seed=7).collect()} != again


def test_overlapping_sources(spark):
    rows = [(k, "w " * (1 + k % 5), [["a"], ["b"], ["a", "b"], ["b", "a", "a"], [], None][k % 6]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out = mix(df, weights=(3, 1)).collect()
    total = sum(x["size"] for x in out)
    assert abs(sum(x.taken for x in out) - total) <= 20
    assert max(x.copies for x in out) <= 3


def test_empty_nulls_and_a_single_word(spark):
    assert mix(documents(spark, [])).count() == 0
    out = mix(documents(spark, [(None, "a b", None), (None, "a b", None), (1, "a", "s"), (1, "a", "s")])).collect()
    assert len(out) == 4 and sum(x.taken for x in out if x.source is None) in (1, 2, 3, 4)
    assert mix(documents(spark, [(1, None, "a"), (2, "", None)])).agg({"taken": "sum"}).first()[0] == 0


def test_too_many_patterns_is_an_error(spark):
    with pytest.raises(ValueError):
        mix(documents(spark, [(k, "a", str(k)) for k in range(6)]), max_patterns=5)


def test_fractions_stay_exact():
    assert targets(7, [3, 4], [5, 2]) == [Fraction(5), Fraction(2)]
    assert mixing.targets(1, [1], [5]) == [1]
