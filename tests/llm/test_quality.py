import random
import re
import string

import zstandard

from trackframe.llm.quality import Bands, quality_rules, repeated_words
from trackframe.llm.queries import op1_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    ws = WORD.findall(text or "")
    windows = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    again = {k for k, w in enumerate(windows) if windows.count(w) > 1}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(ws),
        sum(map(len, ws)),
        sum(c in "#*$%&|<>" for c in text or ""),
        sum(x in lines[:k] for k, x in enumerate(lines)),
        len({k + j for k in again for j in range(3)}),
    )


def test_counts_match_brute_force(make):
    r = random.Random(1)
    texts = [None, "", " \n\t", "one", "a b c", "a a a a", "é ü x y", "x\n\ny\nx\n x\nx"]
    texts += ["".join(r.choice("ab \n#é|\x0b\t") for _ in range(r.randrange(400))) for _ in range(60)]
    texts += ["a b c " * 3000 + "end"]
    out = quality_rules(make(texts, extra=True)).collect()
    assert len(out) == len(texts)
    for row in out:
        got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert got == brute(texts[row.doc_id]), texts[row.doc_id]
        assert row.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (row.base_failed and row.kept)


def test_windows_wider_than_an_integer():
    words = [str(k % 90_001).encode() for k in range(200_000)]
    assert repeated_words(words, 5) == repeated_words(words, 4)


def test_bands(make, words):
    r = random.Random(2)
    noise = "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(6000))
    noise = " ".join(noise[k : k + 60] for k in range(0, 6000, 60))
    prose = words(800)
    texts = [prose, " ".join(f"go{k % 7} up" for k in range(900)), noise, prose + " " + "x y " * 8000, ""]
    rows = {x.doc_id: x for x in quality_rules(make(texts)).collect()}
    assert rows[0].kept and rows[0].band == "pass"
    assert [rows[k].band for k in (1, 2, 3, 4)] == ["repetitive", "incompressible", "repetitive", "empty"]
    assert not any(rows[k].kept for k in (1, 2, 3, 4)) and rows[4].ratio is None


def test_chunks_show_what_the_whole_hides(make, words):
    text = words(6000, vocabulary=6000) + " " + "same line of text\n" * 2600
    whole = Bands(chunk_share=1.0, whole=((0, 0.0, 99.0),))
    by_chunk = Bands(chunk_share=0.3, whole=((0, 0.0, 99.0),))
    assert quality_rules(make([text]), whole).first().band == "pass"
    assert quality_rules(make([text]), by_chunk).first().band == "repetitive"


def test_empty_table_repeats_and_null_ids(make):
    assert quality_rules(make([])).count() == 0
    assert quality_rules(make([(None, "a"), (None, "a"), (3, None)])).count() == 3


def brute_band(text):
    """The verdict of the bands by plain loops, from the limits of the production setting."""
    bands, raw = Bands(), (text or "").encode()
    if not raw:
        return "empty", 0, 0

    def ratio(data):
        return len(data) / len(zstandard.compress(data, 3))

    def outside(data, limits):
        r = ratio(data)
        return -1 if r < limits[0] else 1 if r > limits[1] else 0

    def of_length(n):
        return [(low, high) for start, low, high in bands.whole if start <= n][-1]

    chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    bad = [outside(c, bands.chunk_band if len(c) == 4096 else of_length(len(c))) if len(chunks) > 1 else 0 for c in chunks]
    share = {s: sum(len(c) for c, b in zip(chunks, bad) if b == s) / len(raw) for s in (-1, 1)}
    whole = outside(raw, of_length(len(raw)))
    if whole > 0 or share[1] > 0.4:
        judged = "repetitive"
    elif whole < 0 or share[-1] > 0.4:
        judged = "incompressible"
    else:
        judged = "mixed" if share[1] + share[-1] > 0.4 else "pass"
    return judged, len(chunks), sum(map(bool, bad))


def test_query_against_brute_force(spark, sf, words, tmp_path):
    """The query itself: base counts and verdicts of the bundled documents and of awkward ones."""
    r = random.Random(9)
    texts = [t for (t,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    noise = " ".join("".join(r.choice(string.printable[:90]) for _ in range(40)) for _ in range(150))
    prose = words(3000, 3, 2000)
    texts += [None, "", "a", prose[:4096], prose[:4097], prose[:8191], prose[:8192], prose[:4096] + "ab " * 1200, prose[:5000] + noise[:4000]]
    texts += [words(30_000, 4, 3000), "x" * 200_000, prose[:4096] + noise[:4096]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op1_quality_rules(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in out) == list(range(len(texts)))
    for x in out:
        text = texts[x.doc_id]
        if len(text or "") < 20_000:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(text)
        assert (x.band, x.n_chunks, x.n_bad_chunks) == brute_band(text)
        assert x.kept == (not x.base_failed and x.band == "pass")


def test_every_byte_is_in_a_chunk(make, words):
    """A repetitive tail is seen although it is no full chunk and the text as a whole has an ordinary ratio."""
    prose = words(900, 1, 900).encode()[:4096].decode()
    tail = "the very same line\n" * 180
    rows = {x.doc_id: x for x in quality_rules(make([prose, prose + tail, prose + prose[:3400][::-1]])).collect()}
    assert rows[1].ratio < Bands().limits(rows[1].n_bytes)[1] and rows[1].n_bytes < 8192
    assert (rows[0].band, rows[1].band, rows[2].band) == ("pass", "repetitive", "pass")
    assert (rows[1].n_chunks, rows[1].n_bad_chunks) == (2, 1)
