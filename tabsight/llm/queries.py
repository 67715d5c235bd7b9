"""Registered queries of the numbered operators, over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import urlfilter


@dataclass
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = Query(fn, sql)
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_vocabulary() -> str:
    """Path of the public word-level vocabulary; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    """Path of the public SentencePiece model; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


_OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS DISTINCT FROM d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@_register("op1_warc_segments", _OP1)
def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.warc import read_archives, resolve_revisits, write_archives
    root, manifest = write_archives(spark, _table(spark, sf_dir, "pages"))
    return resolve_revisits(spark, read_archives(spark, root, manifest)).drop("error")


_OP2 = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@_register("op2_topk_threshold", _OP2)
def op2_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.topk import exact_topk, quantised
    v = quantised(_table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), "vec")
    return exact_topk(spark, v, v.filter(F.col("id") % 100 == 0), k=10)


def _op3_sql() -> str:
    known = urlfilter.default_vocabulary()

    def hit(term):
        text = re.escape(term).replace("'", "''")
        return f"regexp_matches(u, '(^|[^a-z0-9]){text}([^a-z0-9]|$)')"

    strict = " OR ".join(hit(t) for t in known.strict)
    soft = " + ".join(f"CASE WHEN {hit(t)} THEN {w} ELSE 0 END" for t, (_, w) in known.soft.items())
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))

    def case(value):
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'"
                                  for v, h, p in rules) + " END"

    return f"""
WITH s AS (SELECT page_id, lower(coalesce(url, '')) AS u,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled,
    ({strict})::INT AS strict_hit, ({soft})::DOUBLE AS soft_weight FROM s)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict_hit > 0 OR soft_weight >= {known.limit}
    THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


@_register("op3_url_vocabulary", _op3_sql())
def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@_register("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.packing import pack_documents
    return pack_documents(spark, _table(spark, sf_dir, "documents"), word_vocabulary(), end_id=1, max_len=4096)


_OP5 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, coalesce(text, '') AS text,
                  doc_id IS NULL OR count(*) OVER (PARTITION BY doc_id) > 1 AS tied FROM documents),
t AS (SELECT rid, doc_id, {'doc': doc, 'tie': CASE WHEN tied THEN ('0x' || substr(sha256(text), 1, 15))::BIGINT ELSE 0 END} AS who, text FROM d),
l AS (SELECT rid, doc_id, who, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(who) AS first FROM k WHERE length(key) >= 10 GROUP BY 1),
m AS (SELECT k.*, f.first IS NOT NULL AND f.first <> k.who AS dropped FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid
"""


@_register("op5_line_runs", _OP5)
def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.linededup import dedup_lines
    out = dedup_lines(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@_register("op6_quality_ratio")
def op6_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.quality import judge_quality
    out = judge_quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "llr", "threshold")


@_register("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of ids of the whole text, their CRC-32, and that of the text decoded from them."""
    from tabsight.llm.spiece import encode_pieces
    return encode_pieces(_table(spark, sf_dir, "documents"), piece_vocabulary(), ("n_tokens", "ids_crc32", "decoded_crc32"))


@_register("op8_language_masks")
def op8_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.langid import held_out, identify_languages
    out = identify_languages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_register("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.tokenfile import read_token_index, write_token_files
    files = write_token_files(spark, _table(spark, sf_dir, "documents"), word_vocabulary(), end_id=2)
    return read_token_index(spark, files)


@_register("op10_odd_sketches")
def op10_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.oddsketch import near_duplicates
    return near_duplicates(spark, _table(spark, sf_dir, "documents"), width=4, percent=80)


@_register("op11_target_alignment")
def op11_target_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.staging import Stage
    from tabsight.llm.turns import audit_conversations, damaged, repaired_digests
    order = ("file_name", "row_index")      # turns of equal number stay in file order
    turns = damaged(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", "_metadata.file_name",
                                                                  "_metadata.row_index"), order)
    audits = Stage(spark, "audits").put(audit_conversations(spark, turns, order, "present"))
    digests = repaired_digests(turns, audits, order, "present")
    return audits.join(digests, audits.conv_id.eqNullSafe(digests.conv)).drop("conv")


@_register("op12_transducer_lexicon")
def op12_transducer_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.lexicon import encoding_digests
    return encoding_digests(spark, _table(spark, sf_dir, "documents"), word_vocabulary())


@_register("op13_difference_cover_runs")
def op13_difference_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsight.llm.periodic import planted_period, run_digests
    return run_digests(_table(spark, sf_dir, "documents"), planted_period)
