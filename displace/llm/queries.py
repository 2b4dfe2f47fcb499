"""The queries of the text operators, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from displace.llm.decontaminate import contaminated_words, contamination_digest
from displace.llm.imatch import imatch_report
from displace.llm.language_model import score_texts
from displace.llm.packing import pack_documents
from displace.llm.pieces import Model, encode_texts, pieces_digest
from displace.llm.quality import score_quality
from displace.llm.repeats import remove_repeats, spans_digest
from displace.llm.secrets import BASE, MORE, find_secrets, secrets_digest
from displace.llm.simhash import simhash_components
from displace.llm.toxicity import score_toxicity
from displace.llm.variants import spelling_variants
from displace.llm.warc import plan_revisits, read_warc, resolve_revisits, write_warc
from displace.llm.whitening import whiten
from displace.session import fresh_path


#: Where the model's file lies; a path on the driver.
PIECES = os.environ.get("DISPLACE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: The vocabulary of op12; a path on the driver.
BYTES = os.environ.get("DISPLACE_BYTES", "/opt/tokenizers/byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(plan_revisits(_table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return resolve_revisits(read_warc(spark, path))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces_digest(encode_texts(docs, Model.load(PIECES), decoded="decoded"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_digest(remove_repeats(_table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_report(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = score_quality(docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "content_score", "metadata_score", "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(BYTES, encoding="utf-8") as vocabulary:
        return pack_documents(_table(spark, sf_dir, "documents"), vocabulary.read())


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_pieces": op2_pieces,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_gru_lm": op6_gru_lm,
    "op7_toxicity": op7_toxicity,
    "op8_imatch": op8_imatch,
    "op9_secrets": op9_secrets,
    "op10_cotrain": op10_cotrain,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_variants": op13_variants,
}

def _secrets_sql() -> str:
    """The same rules: pieces between matches and the matches' lengths add up to places."""
    parts = []
    # the contract's own expressions: short matches are dropped afterwards
    plain = {"access": ("AKIA[A-Z0-9]+", 20), "hex": ("[0-9a-f]+", 24)}
    for i, r in enumerate(BASE + MORE):
        pattern, least = plain.get(r.kind, (r.pattern, r.least))
        p = pattern.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {i} AS k, '{r.kind}' AS kind, list_sum(list_transform(list_slice(gaps, 1, j), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(ms, 1, j - 1), lambda g: length(g))), 0) AS st,
               length(ms[j]) AS n, length(cs[j]) AS c
        FROM (SELECT doc_id, gaps, ms, cs, unnest(range(1, len(ms) + 1)) AS j
              FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {r.group}) AS cs FROM d WHERE regexp_matches(t, '{p}')))
        WHERE length(cs[j]) >= {least}""")
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({" UNION ALL ".join(parts)}),
        s AS (SELECT doc_id, k, st, kind || ':' || CAST(CAST(st AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(st + n AS BIGINT) AS VARCHAR) AS w FROM m),
        g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS h,
                     string_agg(w, ',' ORDER BY st, k) FILTER (k < 3) AS base, string_agg(w, ',' ORDER BY st, k) AS spans FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (doc_id)
    """


ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM m
    """,
    "op4_decontaminate": r"""
        WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, s, s + least(len(w), 13) - 1) AS g
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        dwin AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g
                 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, s, n FROM dwin JOIN win USING (n, g)),
        hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
    """,
    "op9_secrets": _secrets_sql(),
}
