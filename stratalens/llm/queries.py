"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import mixing, origin, pieces, secrets, sentences, spans, syntax, tokens, topn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": pieces.p1_found,
        "p1_pieces": pieces.p1_pieces,
        "p1_rebuilt": pieces.p1_rebuilt,
        "p2_found": origin.p2_found,
        "p2_origin": origin.p2_origin,
        "p3_found": topn.p3_found,
        "p4_found": secrets.p4_found,
        "p4_redacted": secrets.p4_redacted,
        "p5_found": syntax.p5_found,
        "p5_files": syntax.p5_files,
        "p5_rates": syntax.p5_rates,
        "p6_found": spans.p6_found,
        "p6_files": spans.p6_files,
        "p6_classes": spans.p6_classes,
        "p6_removed": spans.p6_removed,
        "p6_kept": spans.p6_kept,
        "p7_ids": tokens.p7_ids,
        "p7_roundtrip": tokens.p7_roundtrip,
        "p9_found": sentences.p9_found,
        "p8_mixture": mixing.p8_mixture,
        "p8_shares": mixing.p8_shares,
        "p8_bounds": mixing.p8_bounds,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            select distinct 'file' as item_kind, file_id as item_id from files where strlen(content) > 8000
            union all
            select distinct 'symbol', symbol_id from symbols where strlen(source_span) > 8000""",
        "p1_rebuilt": """
            select distinct 'file' as item_kind, file_id as item_id, sha256(content) as digest, true as within_limit, true as cut from files where strlen(content) > 8000
            union all
            select distinct 'symbol', symbol_id, sha256(source_span), true, true from symbols where strlen(source_span) > 8000""",
        "p7_roundtrip": "select doc_id, sha256(coalesce(text, '')) as digest from documents",
        "p8_bounds": """
            select s.source, coalesce(n, 0) as docs_available, false as over_the_cap, false as over_the_docs
            from (select distinct lower(trim(source)) as source from mix_targets where source is not null and target_share > 0) s
            left join (select lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) as source, count(*) as n from documents where text <> '' group by 1) d on d.source = s.source""",
        "p3_found": """
            with latest as (
              select * from nodes
              qualify row_number() over (partition by repository_id, node_id order by indexed_at desc nulls last) = 1
            )
            select repository_id, community_id,
                   cast(row_number() over (partition by repository_id, community_id order by pagerank desc, node_id) as integer) as rank_no,
                   node_id
            from latest
            where node_type = 'file' and community_id is not null and pagerank is not null and not isnan(pagerank)
            qualify row_number() over (partition by repository_id, community_id order by pagerank desc, node_id) <= 5""",
    }
