"""License scans: sparse TF-IDF cosine to templates, and inheritance along directories.

A file's header passages (lines, pairs of lines and paragraphs that speak of a licence, wherever they stand in the
whole text) and, for a licence file, its whole text are compared with the templates: full texts, headers, short notices
and tags. A file without a licence of its own has that of the nearest directory above it, its own included, that holds
a licence file.

Everything is DataFrame functions. A passage is compared once, however many files have it: its tokens are counted by an
aggregate and meet the templates' weights in a broadcast join. Inheritance is a join of directories with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackframe.llm.common import cut
from trackframe.llm.license_texts import templates as known_texts

#: A line that may be a notice.
HEADER = r"(?i)licen[cs]e|copyright|spdx|all rights reserved|warrant|public domain|permission is hereby|released under"
#: A file that holds a directory's licence.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
TOKEN = r"[\p{L}\p{N}.+-]*[\p{L}\p{N}]"
#: Between paragraphs.
BLANK = r"\n[ \t]*\n"
#: Bounds of the broadcast table of weights.
MAX_TEMPLATES = 2_000
MAX_TEMPLATE_TOKENS = 1_000_000


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


class Templates:
    """Template vectors of length 1 and the inverse document frequencies over the templates; ``licenses`` has the licence of each."""

    def __init__(self, texts: Mapping[str, str | Sequence[str]]):
        pairs = [(name, t) for name, given in sorted(texts.items()) for t in ([given] if isinstance(given, str) else given)]
        split = [(name, re.findall(r"(?:[^\W_]|[.+-])*[^\W_]", t.lower())) for name, t in pairs]
        self.licenses = [name for name, _ in split]
        if len(split) > MAX_TEMPLATES or sum(len(set(tokens)) for _, tokens in split) > MAX_TEMPLATE_TOKENS:
            raise ValueError(f"more than {MAX_TEMPLATES} templates or {MAX_TEMPLATE_TOKENS} tokens")
        df = Counter(t for _, tokens in split for t in set(tokens))
        n = len(split)
        self.unknown = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in sorted(df.items())}
        self.vectors = []
        for _, tokens in split:
            raw = {t: k * self.idf[t] for t, k in sorted(Counter(tokens).items())}
            norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
            self.vectors.append({t: v / norm for t, v in raw.items()})

    def table(self, spark: SparkSession) -> DataFrame:
        """token, idf and its weight in each template that has it."""
        entries: dict[str, list] = {t: [] for t in self.idf}
        for k, vector in enumerate(self.vectors):
            for t, w in vector.items():
                entries[t].append((k, w))
        rows = [(t, self.idf[t], e) for t, e in entries.items()]
        return spark.createDataFrame(rows, "token string, idf double, entries array<struct<t:int,w:double>>")


def cosines(passages: DataFrame, known: Templates) -> DataFrame:
    """(pid, cosine, license): the most similar template of every passage (pid, passage); none without a token or template.

    The greater cosine wins, then the first name.
    """
    spark = passages.sparkSession
    counts = passages.select("pid", F.explode(_tokens(F.col("passage"))).alias("token")).groupBy("pid", "token").agg(F.count("*").alias("n"))
    weighed = counts.join(F.broadcast(known.table(spark)), "token", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(known.unknown)))
    own = F.array(F.struct(F.lit(-1).alias("t"), (F.col("w") * F.col("w")).alias("s")))
    dots = F.transform(F.coalesce("entries", F.array().cast("array<struct<t:int,w:double>>")), lambda e: F.struct(e["t"].alias("t"), (F.col("w") * e["w"]).alias("s")))
    sums = weighed.select("pid", F.explode(F.concat(own, dots)).alias("e")).groupBy("pid", "e.t").agg(F.sum("e.s").alias("s"))
    norm = F.max(F.when(F.col("t") < 0, F.col("s"))).over(Window.partitionBy("pid"))
    names = spark.createDataFrame(list(enumerate(known.licenses)), "t int, license string")
    judged = sums.withColumn("norm", norm).where("t >= 0").join(F.broadcast(names), "t")
    judged = judged.withColumn("c", -F.round(F.col("s") / F.sqrt("norm"), 9))
    best = judged.groupBy("pid").agg(F.min(F.struct("c", "license")).alias("b"))
    return best.select("pid", (-F.col("b.c")).alias("cosine"), F.col("b.license").alias("license"))


def passages_of(text: Column, is_file: Column) -> Column:
    """The passages of a text that may be notices: lines, pairs of adjacent lines and paragraphs that match HEADER; all of a licence file."""
    lines = F.split(text, "\n")
    speaks = lambda x: x.rlike(HEADER)
    pairs = F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda a, b: F.concat_ws("\n", a, b))
    parts = F.concat(F.filter(lines, speaks), F.filter(pairs, speaks), F.filter(F.split(text, BLANK), speaks))
    parts = F.when(speaks(text), parts).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(is_file, F.concat(F.array(text), parts)).otherwise(parts))


def scan_licenses(files: DataFrame, templates: Mapping[str, str | Sequence[str]] | None = None, threshold: float = 0.7) -> DataFrame:
    """The licence of every file: its own, or that of the nearest directory above.

    ``files`` has doc_id, path ('/' between names) and text. Returns a row per input row: doc_id, path, ``own_license`` and
    ``cosine`` (the most similar template of its header passages, or of its whole text in a licence file, at
    ``threshold`` or more), ``license`` (own or inherited), ``license_from`` (the directory it is inherited from)
    and ``origin`` ('header', 'file', 'inherited' or 'none'). ``templates`` has a text or several for each licence;
    unless given they are those of ``license_texts``.

    Where two passages or licence files compete the greater cosine wins, then the first name. A null or empty text
    has no licence of its own. A file with a null path inherits nothing, and '' is the directory of a path
    without '/'. Repeated rows are scanned each, though equal passages are compared once; other columns are ignored. The
    weights are broadcast, at most a million. A directory or passage that a third of all files has is a skewed
    join key, which Spark splits. The texts are read once; passages and paths are written to the checkpoint folder.
    """
    known = Templates(known_texts() if templates is None else templates)
    rows = files.select(
        F.col("doc_id").cast("long"), F.col("path").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    rows = rows.withColumn("is_file", is_file).withColumn("passages", passages_of(F.col("text"), F.col("is_file")))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "path", "is_file", "passages"))
    # From here on rid is read from what was written, so it does not change.
    found = rows.select("rid", F.explode("passages").alias("passage")).withColumn("pid", F.unhex(F.md5("passage")))
    scored = cosines(found.select("pid", "passage").dropDuplicates(["pid"]), known).where(F.col("cosine") >= threshold)
    best = found.select("rid", "pid").join(scored, "pid").groupBy("rid").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    best = best.select("rid", (-F.col("b.c")).alias("cosine"), F.col("b.license").alias("own_license"))
    scanned = rows.drop("passages").join(best, "rid", "left").withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    scanned = cut(scanned.drop("rid"))
    held = (
        scanned.where("is_file and own_license is not null and dir is not null")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own_license")).alias("m"))
        .select(F.col("dir").alias("above"), F.col("m.own_license").alias("given"))
    )
    parts = F.split("dir", "/")
    dirs = scanned.where("dir is not null").select("dir").distinct()
    ancestors = dirs.select(
        "dir",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
        ).alias("a"),
    ).select("dir", "a.depth", "a.above")
    inherited = ancestors.join(held, "above").groupBy("dir").agg(F.max(F.struct("depth", "given", "above")).alias("m"))
    inherited = inherited.select("dir", F.col("m.given").alias("given"), F.col("m.above").alias("above"))
    out = scanned.join(inherited, "dir", "left")
    origin = (
        F.when(F.col("own_license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header"))
        .when(F.col("given").isNotNull(), "inherited")
        .otherwise("none")
    )
    return out.select(
        "doc_id",
        "path",
        "own_license",
        "cosine",
        F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("above")).alias("license_from"),
        origin.alias("origin"),
    )
