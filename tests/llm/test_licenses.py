import math
import re
from pathlib import Path

import pytest

from trackframe.llm.license_texts import GNU_HEADER, HEADERS, NAMES, TEXTS, templates
from trackframe.llm.licenses import scan_licenses
from trackframe.llm.queries import op6_license_scan

#: One notice of some licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}

ROOT = Path(__file__).resolve().parents[2]
SF_LARGER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, path string, text string"


def brute_cosine(text, template, templates):
    token = re.compile(r"(?:[^\W_]|[.+-])*[^\W_]")
    split = [token.findall(t.lower()) for t in templates.values()]
    n = len(split)

    def vector(s):
        ts = token.findall(s.lower())
        return {t: ts.count(t) * (math.log((1 + n) / (1 + sum(t in x for x in split))) + 1) for t in ts}

    a, b = vector(text), vector(template)
    dot = sum(v * b.get(t, 0) for t, v in a.items())
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def scan(spark, rows, **more):
    return {x.doc_id: x for x in scan_licenses(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def test_headers_anywhere_in_the_text(spark):
    filler = "some prose here\n" * 2000
    out = scan(
        spark,
        templates=TEMPLATES,
        rows=[
            (1, "a/x.txt", filler + TEMPLATES["MIT"] + "\n" + filler),
            (2, "a/y.txt", "// licensed under the apache license, version 2.0 (see file)"),
            (3, "a/z.txt", filler),
            (4, "a/w.txt", "a licence to be silly"),
        ],
    )
    assert (out[1].license, out[1].origin, out[1].cosine) == ("MIT", "header", 1.0)
    assert out[2].license == "Apache-2.0"
    expected = brute_cosine("// licensed under the apache license, version 2.0 (see file)", TEMPLATES["Apache-2.0"], TEMPLATES)
    assert out[2].cosine == pytest.approx(expected, abs=1e-8)
    assert out[3].origin == out[4].origin == "none"


def test_nearest_ancestor(spark):
    gpl, mit = TEMPLATES["GPL-3.0"], TEMPLATES["MIT"]
    out = scan(
        spark,
        [
            (1, "LICENSE", gpl),
            (2, "a/b/LICENSE.txt", mit),
            (3, "a/x.py", "none here"),
            (4, "a/b/c/d/y.py", "nor here"),
            (5, "a/b/z.py", TEMPLATES["Apache-2.0"]),
            (6, "top.py", ""),
            (7, "a/bc/z.py", None),
            (8, None, "no path"),
        ],
    )
    got = {k: (x.license, x.license_from, x.origin) for k, x in out.items()}
    assert got == {
        1: ("GPL-3.0", None, "file"),
        2: ("MIT", None, "file"),
        3: ("GPL-3.0", "", "inherited"),
        4: ("MIT", "a/b", "inherited"),
        5: ("Apache-2.0", None, "header"),
        6: ("GPL-3.0", "", "inherited"),
        7: ("GPL-3.0", "", "inherited"),
        8: (None, None, "none"),
    }


def test_two_licence_files_and_repeats(spark):
    rows = [(1, "p/COPYING", TEMPLATES["MIT"]), (2, "p/LICENSE", TEMPLATES["GPL-3.0"] + " more words"), (3, "p/f", "x"), (3, "p/f", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' as dir", "1 as lines", "2 as best")
    out = scan_licenses(df).collect()
    assert len(out) == 4 and [x.license for x in out if x.doc_id == 3] == ["MIT", "MIT"]


def test_empty_and_other_templates(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    out = scan(spark, [(1, "a", "license: be kind")], templates={"kind": "license: be kind", "other": "license: pay"})
    assert out[1].license == "kind"
    assert scan(spark, [(1, "a", "license: be kind")], templates={})[1].origin == "none"


def test_plan_is_native(spark):
    """Of every execution, those that write the checkpoints included."""
    for module in ("licenses", "license_texts"):
        with open(f"{ROOT}/trackframe/llm/{module}.py") as source:
            assert not re.search(r"mapInArrow|mapInPandas|udf|toPandas|toArrow|\.rdd|collect\(\)", source.read())
    plan = scan_licenses(spark.createDataFrame([(1, "a", "b")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_published_texts_and_notices(spark):
    """Full texts under a copyright line, headers in comments, short notices and tags are told apart."""
    rows, expected = [], []

    def add(path, text, key):
        rows.append((len(rows), path, text))
        expected.append(key)

    for key, text in TEXTS.items():
        add(f"{key}/LICENSE", f"{NAMES[key]}\n\nCopyright (c) 2020 Some One\n\n{text}\n", key)
        add(f"src/{key}.c", "\n".join(f" * {x}" for x in text.split("\n")) + "\n\n" + "int x = 1;\n" * 50, key)
    for key, text in HEADERS.items():
        add(f"h/{key}.py", "\n".join(f"# {x}" for x in text.split("\n")) + "\n\nimport this\n" * 40, key)
    add("h/agpl.py", GNU_HEADER.format(name="GNU Affero General Public License", version="3"), "AGPL-3.0")
    for key in NAMES:
        add(f"t/{key}.rs", f"fn main() {{}}\n// SPDX-License-Identifier: {key}\n", key)
        for k, text in enumerate(t for t in templates()[key] if len(t) < 100):
            add(f"n/{key}{k}.rs", f"one line\n{text}\nanother line", key)
    out = scan(spark, rows)
    assert [out[k].own_license for k in range(len(rows))] == expected


def test_notice_over_two_lines(spark):
    rows = [
        (1, "a", "prose\nThis work is licensed under the GNU General\nPublic License, version 3.\nmore prose " + "words " * 300),
        (2, "b", "Licensed under the Apache\nLicense, Version 2.0.\n\nother"),
        (3, "c", "All rights reserved."),
    ]
    out = scan(spark, rows)
    assert (out[1].own_license, out[2].own_license, out[3].own_license) == ("GPL-3.0", "Apache-2.0", None)


def test_very_long_line_and_a_passage_that_all_have(spark):
    long = "license " + "word%d " * 3
    rows = [(0, "a/LICENSE", " ".join(f"license w{k % 5000}" for k in range(200_000))), (1, "a/x", long)]
    rows += [(k, f"b/{k}", TEMPLATES["MIT"]) for k in range(2, 600)]
    out = scan(spark, rows)
    assert out[0].own_license is None and all(out[k].own_license == "MIT" and out[k].cosine == 1.0 for k in range(2, 600))


def test_query_reaches_past_the_next_directory(spark):
    """In the query's own paths some files inherit from two directories above."""
    above = [x.path.count("/") - x.license_from.count("/") - 1 for x in op6_license_scan(spark, SF_LARGER).where("license_from is not null").collect()]
    assert {0, 1, 2} <= set(above)
