"""A query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.llm import bpe, chat, langid, licenses, media, mixing, quality, simhash, substring, toxicity
from trackframe.llm.license_texts import templates as known_texts

RANKS = "byte_bpe_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


#: Chain order and the condition on ``labels`` that each category stands for.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chain = toxicity.train(docs, read(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.classify(docs, chain)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path, pattern = tokenizer()
    made = bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: A line of a text that is a notice of its own.
NOTICE = r"(?m)^(Licensed|Released|This work is licensed) under [^\n]+[.]$"


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files in source / ten thousand / thousand / hundred of their id.

    Of those with a notice line one in four is a licence file, of its hundred or of one or two directories above.
    """
    levels = [F.floor(F.col("doc_id") / n).cast("string") for n in (10_000, 1_000, 100)]
    notice = F.coalesce(F.col("text").rlike(NOTICE), F.lit(False)) & (F.col("doc_id") % 4 == 0)
    above = [F.when(~F.coalesce(notice, F.lit(False)) | (F.col("doc_id") % 3 >= k), levels[k]) for k in (1, 2)]
    name = F.concat(F.when(notice, F.lit("LICENSE-")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), levels[0], *above, name)
    return docs.select("doc_id", path.alias("path"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(document_paths(read(spark, sf_dir, "documents")))
    return out.withColumn("cosine", F.round("cosine", 6))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    references, lists, chunks = media.store(read(spark, sf_dir, "documents"))
    return references.join(media.media_facts(media.rebuild(lists, chunks)), "key").drop("key")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, ~langid.held_out())
    out = langid.identify(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


#: The conversation that the contract adds: its text holds the template's own control strings.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(rows.unionByName(extra))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("formatted"), F.col("turns"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_toxicity,
        op3_simhash,
        op4_bpe,
        op5_substring_dedup,
        op6_license_scan,
        op7_media_chunks,
        op8_source_mix,
        op9_language_id,
        op10_chat_format,
    )
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"



def _license_sql() -> str:
    """The scan of documents as SQL: the templates' weights are tables."""
    known = licenses.Templates(known_texts())
    idf = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in known.idf.items())
    vectors = ", ".join(f"({k}, '{known.licenses[k]}', '{t}', {w!r}::DOUBLE)" for k, v in enumerate(known.vectors) for t, w in v.items())
    return f"""
WITH idf(token, idf) AS (VALUES {idf}), vectors(k, license, token, weight) AS (VALUES {vectors}),
files AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, doc_id % 4 = 0 AND coalesce(regexp_matches(text, '{NOTICE}'), false) AS is_file,
         coalesce(source, '') || '/' || (doc_id // 10000)::VARCHAR AS top, '/' || (doc_id // 1000)::VARCHAR AS mid, '/' || (doc_id // 100)::VARCHAR AS low
  FROM documents
), marked AS MATERIALIZED (
  SELECT doc_id, text, is_file, top || CASE WHEN NOT is_file OR doc_id % 3 >= 1 THEN mid ELSE '' END || CASE WHEN NOT is_file OR doc_id % 3 >= 2 THEN low ELSE '' END AS dir,
         CASE WHEN is_file THEN 'LICENSE-' ELSE '' END || doc_id::VARCHAR || '.txt' AS name
  FROM files
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM marked
), pairs AS (
  SELECT doc_id, concat_ws(chr(10), line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos)) AS line FROM lines
), passages AS MATERIALIZED (
  SELECT DISTINCT doc_id, line FROM (
    SELECT doc_id, line FROM lines UNION ALL SELECT doc_id, line FROM pairs
    UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '{licenses.BLANK}')) AS line FROM marked
  ) WHERE regexp_matches(line, '{licenses.HEADER}')
  UNION SELECT doc_id, text FROM marked WHERE is_file
), words AS (
  SELECT doc_id, line, unnest(regexp_extract_all(lower(line), '{licenses.TOKEN}')) AS token FROM passages
), weights AS MATERIALIZED (
  SELECT doc_id, line, token, count(*) * coalesce(any_value(idf), {known.unknown!r}) AS w FROM words LEFT JOIN idf USING (token) GROUP BY doc_id, line, token
), norms AS (
  SELECT doc_id, line, sqrt(sum(w * w)) AS n FROM weights GROUP BY doc_id, line
), cosines AS (
  SELECT doc_id, license, max(c) AS c FROM (
    SELECT doc_id, line, k, any_value(license) AS license, round(sum(w * weight) / any_value(n), 9) AS c
    FROM weights JOIN vectors USING (token) JOIN norms USING (doc_id, line) GROUP BY doc_id, line, k
  ) GROUP BY doc_id, license
), own AS (
  SELECT doc_id, license AS own_license, c AS cosine FROM cosines WHERE c >= 0.7
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, license) = 1
), held AS (
  SELECT dir AS above, own_license AS given FROM marked JOIN own USING (doc_id) WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, own_license) = 1
), dirs AS (
  SELECT DISTINCT dir, string_split(dir, '/') AS parts FROM marked
), ancestors AS (
  SELECT dir, depth, array_to_string(parts[1:depth], '/') AS above FROM (SELECT dir, parts, unnest(range(0, len(parts) + 1)) AS depth FROM dirs)
), nearest AS (
  SELECT dir, given, above FROM ancestors JOIN held USING (above)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1
)
SELECT doc_id, dir || '/' || name AS path, own_license, round(cosine, 6) AS cosine, coalesce(own_license, given) AS license,
       CASE WHEN own_license IS NULL AND given IS NOT NULL THEN above END AS license_from,
       CASE WHEN own_license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM marked LEFT JOIN own USING (doc_id) LEFT JOIN nearest USING (dir)
"""


#: SQL for those that SQL can express; the others are tested against brute force, a library or held-out rows.
ORACLES: dict[str, str] = {
    "op5_substring_dedup": f"""
WITH split AS MATERIALIZED (
  SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, k, md5(array_to_string(ws[k:k + 49], ' ')) AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS k FROM split WHERE len(ws) >= 50)
), firsts AS (
  SELECT w, min(doc_id) AS low FROM windows GROUP BY w
), gone AS (
  SELECT doc_id, list(k ORDER BY k) AS starts FROM windows JOIN firsts USING (w) WHERE doc_id > low GROUP BY doc_id
), covered AS (
  SELECT doc_id, list(DISTINCT k + j) AS gone_at
  FROM (SELECT doc_id, unnest(starts) AS k FROM gone), range(50) AS r(j) GROUP BY doc_id
), places AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM split
), marked AS (
  SELECT doc_id, unnest(gone_at) AS p, true AS cut FROM covered
), texts AS (
  SELECT doc_id, count(*) AS n_words, count(cut) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE cut IS NULL), '') AS kept
  FROM places LEFT JOIN marked USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN texts USING (doc_id)
""",
    "op6_license_scan": _license_sql(),
    "op8_source_mix": f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS ord
  FROM documents
), held AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, sum(3 * source_size) OVER o AS capped, sum(weight) OVER o AS capped_weight,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM held
  WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), judged AS (
  SELECT *, (total - (capped - 3 * source_size)) * weight > 3 * source_size * (weights - (capped_weight - weight)) AS over
  FROM ranked
), level AS (
  SELECT any_value(total) - coalesce(sum(3 * source_size) FILTER (WHERE over), 0) AS rest,
         any_value(weights) - coalesce(sum(weight) FILTER (WHERE over), 0) AS open
  FROM judged
), wanted AS (
  SELECT source, source_size,
         CASE WHEN over THEN (3 * source_size)::DOUBLE ELSE (rest * weight)::DOUBLE / open::DOUBLE END AS target,
         CASE WHEN over THEN (3 * source_size)::BIGINT ELSE ((rest * weight) // open)::BIGINT END AS quota
  FROM judged, level
), ordered AS (
  SELECT sized.*, source_size, target, quota, quota // greatest(source_size, 1) AS full_passes,
         quota % greatest(source_size, 1) AS rest,
         sum(size) OVER (PARTITION BY sized.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized JOIN wanted ON sized.source IS NOT DISTINCT FROM wanted.source
)
SELECT doc_id, size, source_size, target,
       (size * (full_passes + CASE WHEN before + size <= rest THEN 1
                                   WHEN before < rest AND 2 * (rest - before) >= size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
""",
    "op10_chat_format": r"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), heads AS (
  SELECT *, replace(replace(replace(replace(replace(role, '\', '\0'), '</turn>', '\1'), '### ', '\2'), chr(10), '\3'), ':', '\4') AS head,
         bool_or(contains(text, '</turn>')) OVER (PARTITION BY conv_id) AS broken,
         contains(text, '</turn>') OR contains(text, '### ') AS own
  FROM rows
), turns AS (
  SELECT *, CASE WHEN broken AND own THEN length(replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '### ', '\2')) + 1
                 ELSE length(text) END AS body
  FROM heads
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(head) + 2 + body + 8)::BIGINT AS formatted_chars,
       true AS round_trip
FROM turns GROUP BY conv_id
""",
}
