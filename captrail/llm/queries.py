"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from . import bpe, ctw, hardneg, jaccard, langmix, linedups, merkle, minhash, mixing, postings, secretscan, suffixes, tokencount
from .common import Query, documents

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query, sql: str | None = None) -> Query:
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLES[fn.__name__] = sql
    return fn


def vocabulary(name: str) -> str:
    """Text of a public tokenizer file; read on the driver, where the package that holds it is installed."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@query
def op1_context_tree_scores(spark, sf_dir):
    return ctw.score_documents(documents(spark, sf_dir))


@query
def op2_jaccard_regions(spark, sf_dir):
    return jaccard.join_documents(documents(spark, sf_dir))


@query
def op3_language_mixture(spark, sf_dir):
    return langmix.held_out_predictions(documents(spark, sf_dir))


@query
def op4_suffix_repeats(spark, sf_dir):
    kept = suffixes.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_posting_lists(spark, sf_dir):
    return postings.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op6_cube_mix(spark, sf_dir):
    return mixing.sample(documents(spark, sf_dir))


@query
def op7_minhash(spark, sf_dir):
    return minhash.fingerprint_documents(documents(spark, sf_dir))


@query
def op8_secret_findings(spark, sf_dir):
    return secretscan.scan_documents(documents(spark, sf_dir))


@query
def op9_bpe_digests(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), digests=True)


@query
def op10_token_counts(spark, sf_dir):
    return tokencount.count_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=1024)


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op11_line_runs(spark, sf_dir):
    kept = linedups.drop_common_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


query(op11_line_runs, f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lines AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
    keyed AS (SELECT *, translate(trim(line, {SPACES}), {ASCII}) AS key FROM lines),
    common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
    judged AS (SELECT *, key IN (SELECT key FROM common) AS dropped FROM keyed)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
    FROM judged JOIN docs USING (r) GROUP BY r""")


def op12_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", moved))


query(op12_hard_negatives, """
    WITH usable AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
        FROM usable a JOIN usable b ON a.id <> b.id WHERE a.id % 100 = 0),
    positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5""")


def _encoded(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


def op13_merkle_manifest(spark, sf_dir):
    return merkle.audit(documents(spark, sf_dir))


query(op13_merkle_manifest, f"""
    WITH RECURSIVE hit AS (
        SELECT *, row_number() OVER () AS r, xor(4294967295, list_reduce(
                   list_prepend(4294967295, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda d: ord(d)::BIGINT)),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 3 = 0 AS hit
        FROM documents),
    headed AS (
        SELECT r, doc_id, lang, text, CASE WHEN hit THEN translate(text, {ASCII}) ELSE text END AS tampered,
               {" || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head
        FROM hit),
    leaves AS (SELECT r, doc_id, lang, sha256(head || {_encoded("text")}) AS leaf, sha256(head || {_encoded("tampered")}) AS bad FROM headed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
    up(lang, lvl, pos, h, n) AS (
        SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM placed
        UNION ALL
        SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM up WHERE n > 1 GROUP BY lang, lvl, pos // 8),
    subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM up WHERE n = 1),
    top(lvl, pos, h, n) AS (
        SELECT 0, spot, subroot, count(*) OVER () FROM subroots
        UNION ALL
        SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY lvl, pos // 8),
    named AS (SELECT placed.*, subroot, spot FROM placed JOIN subroots ON placed.lang IS NOT DISTINCT FROM subroots.lang),
    levels AS (SELECT DISTINCT lang, lvl FROM up WHERE n > 1),
    higher AS (SELECT DISTINCT lvl FROM top WHERE n > 1),
    met AS (
        SELECT r, l.lvl, u.pos, u.h, u.pos < p.pos >> (3 * l.lvl) AS before
        FROM named p JOIN levels l ON p.lang IS NOT DISTINCT FROM l.lang
        JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.lvl = l.lvl AND u.pos >> 3 = p.pos >> (3 * l.lvl + 3)
        WHERE u.pos <> p.pos >> (3 * l.lvl)
        UNION ALL
        SELECT r, 1000 + l.lvl, t.pos, t.h, t.pos < p.spot >> (3 * l.lvl)
        FROM named p, higher l JOIN top t ON t.lvl = l.lvl
        WHERE t.pos >> 3 = p.spot >> (3 * l.lvl + 3) AND t.pos <> p.spot >> (3 * l.lvl)),
    every AS (
        SELECT r, lvl FROM named p JOIN levels l ON p.lang IS NOT DISTINCT FROM l.lang UNION ALL SELECT r, 1000 + lvl FROM named, higher),
    steps AS (
        SELECT e.r, e.lvl, row_number() OVER (PARTITION BY e.r ORDER BY e.lvl) AS k,
               coalesce(string_agg(h, '' ORDER BY pos) FILTER (before), '') AS lefts, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT before), '') AS rights
        FROM every e LEFT JOIN met m ON e.r = m.r AND e.lvl = m.lvl GROUP BY e.r, e.lvl),
    climb(r, k, h) AS (
        SELECT r, 0::BIGINT, bad FROM named
        UNION ALL
        SELECT c.r, s.k, sha256(lefts || c.h || rights) FROM climb c JOIN steps s ON s.r = c.r AND s.k = c.k + 1),
    ends AS (SELECT r, arg_max(h, k) AS folded_root FROM climb GROUP BY r),
    siblings AS (SELECT r, string_agg(lefts || rights, '' ORDER BY k) AS together FROM steps GROUP BY r)
    SELECT doc_id, leaf, subroot, top.h AS root, sha256(coalesce(together, '')) AS proof_sha256, folded_root, folded_root = top.h AS verified
    FROM named JOIN ends USING (r) LEFT JOIN siblings USING (r), top WHERE top.n = 1""")
