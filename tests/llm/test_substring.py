import random

from trackframe.llm import substring
from trackframe.llm.substring import COVER, PERIOD, dedup_substrings


def brute(rows, width=50):
    split = [(d if d is not None else float("inf"), (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, ws in split:
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k : k + width])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, ws in split:
        gone = [False] * len(ws)
        for k in range(len(ws) - width + 1):
            if first[tuple(ws[k : k + width])] < d:
                gone[k : k + width] = [True] * width
        out.append((len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g)))
    return out


def check(make, rows, **more):
    got = dedup_substrings(make(rows, **more)).collect()
    expected = brute([r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)])
    ids = [r[0] if isinstance(r, tuple) else k for k, r in enumerate(rows)]
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, bytes(x.kept)) for x in got) == sorted(
        (str(i), *e) for i, e in zip(ids, expected)
    )
    for x in got:
        assert sum(s.end - s.start for s in x.spans) == x.n_removed
    return got


def test_cover_aligns_any_two_positions():
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER for d in range(PERIOD))


def test_passages_at_every_offset(make, words):
    passage = words(50, 1)
    rows = [words(k, 100 + k) + " " + passage + " " + words(7, 300 + k) for k in range(40)]
    rows += [words(60, 900) + " " + " ".join(passage.split()[:49]) + " other"]
    got = check(make, rows)
    assert sum(x.n_removed for x in got) == 39 * 50


def test_random_mixtures(make, words):
    r = random.Random(8)
    parts = [words(r.randrange(20, 140), s) for s in range(12)]
    rows = [" ".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(60)]
    rows += [None, "", "  ", words(49, 3), words(50, 3), words(50, 3), "la " * 400, "la " * 3000, words(20_000, 4)]
    r.shuffle(rows)
    check(make, rows, extra=True)


def test_the_middle_document_is_the_source(make, words):
    """The first document shares only an anchor's words with the third; the second shares the whole window."""
    shared = words(80, 5).split()
    rows = [
        words(30, 1) + " " + " ".join(shared[20:50]) + " " + words(30, 2),
        words(30, 3) + " " + " ".join(shared) + " " + words(30, 4),
        words(31, 6) + " " + " ".join(shared) + " " + words(30, 7),
    ]
    assert [x.n_removed for x in sorted(check(make, rows), key=lambda x: x.doc_id)] == [0, 0, 80]


def test_null_and_repeated_ids(make, words):
    text, other = words(120, 1), words(120, 2)
    check(make, [(None, text), (None, text), (4, text), (4, text), (4, other), (9, other + " " + text)])


def test_empty_table_and_carried_columns(make, words):
    assert dedup_substrings(make([])).count() == 0
    text = words(60, 1)
    docs = make([text, "x  y", None, text])
    out = {x.doc_id: x for x in dedup_substrings(docs, carry=("source", "lang"), tidy=False).collect()}
    assert bytes(out[1].kept) == b"x  y" and out[2].kept is None and bytes(out[3].kept) == b"" and out[0].source == "s"


def test_window_must_exceed_the_period(make):
    import pytest

    with pytest.raises(ValueError):
        dedup_substrings(make(["a"]), window=31)


def test_hashes_do_not_depend_on_place(words):
    ws = words(300, 1).encode().split()
    a = substring.window_hashes(substring.word_hashes(ws), 20)
    b = substring.window_hashes(substring.word_hashes(ws[17:]), 20)
    assert (a[17:] == b).all() and len(set(a.tolist())) == len(a)
