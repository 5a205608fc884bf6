"""Queries of the operators in this subpackage; each takes (spark, directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicspark.llm import boilerplate, encoding, leaks, mixing, names, neighbors, personal, scans, splitting
from civicspark.sources.tables import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: encoding.damaged_fields(table(s, d, "document_metadata")),
        "p1_repaired": lambda s, d: encoding.repair_fields(table(s, d, "document_metadata")),
        "p2_found": lambda s, d: splitting.oversized_chunks(table(s, d, "chunks")),
        "p2_pieces": lambda s, d: splitting.split_chunks(table(s, d, "chunks")),
        "p3_found": lambda s, d: names.same_authors(table(s, d, "document_metadata")),
        "p3_entities": lambda s, d: names.author_entities(table(s, d, "document_metadata")),
        "p5_found": lambda s, d: scans.noise_kinds(table(s, d, "chunks")),
        "p5_paragraphs": lambda s, d: scans.paragraphs(table(s, d, "chunks")),
        "p6_found": lambda s, d: neighbors.similar_chunks(table(s, d, "chunks")),
        "p7_found": lambda s, d: boilerplate.site_lines(table(s, d, "chunks")),
        "p7_cleaned": lambda s, d: boilerplate.without_site_lines(table(s, d, "chunks")),
        "p8_found": lambda s, d: leaks.leaked_pairs(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_near": lambda s, d: leaks.near_pairs(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_report": lambda s, d: leaks.leak_report(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_mixed": lambda s, d: mixing.mix_sources(table(s, d, "documents"), table(s, d, "source_targets"))[0],
        "p9_shares": lambda s, d: mixing.mix_sources(table(s, d, "documents"), table(s, d, "source_targets"))[1],
        "p10_found": lambda s, d: personal.personal_cases(table(s, d, "documents")),
        "p10_redacted": lambda s, d: personal.redacted(table(s, d, "documents")),
    }


_SPACE = r"[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


#: Words without case and accents, as p8 compares them.
_BARE = "list_filter(regexp_split_to_array(strip_accents(replace(replace(replace(lower({0}), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_PASSAGES = f"""
    WITH i AS (SELECT item_id, w FROM (SELECT item_id, {_BARE.format('question')} AS w FROM eval_items UNION ALL SELECT item_id, {_BARE.format('passage')} FROM eval_items) WHERE len(w) >= 16),
    iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+15], ' ') AS g FROM i, unnest(range(1, len(w) - 14)) AS u(k)),
    d AS (SELECT doc_id, {_BARE.format('text')} AS w FROM documents WHERE text IS NOT NULL),
    dw AS (SELECT doc_id, array_to_string(w[k:k+15], ' ') AS g FROM d, unnest(range(1, len(w) - 14)) AS u(k))
    SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": _PASSAGES,
        "p2_found": rf"SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND length(content) >= 899 AND len(list_filter(regexp_split_to_array(content, '{_SPACE}'), lambda w: w <> '')) > 450",
    }
