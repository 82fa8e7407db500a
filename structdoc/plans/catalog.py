"""The registered queries of the library and their SQL."""

from __future__ import annotations

from structdoc.plans import built, built_sql, capture, literals, pages, relations, sql

__all__ = ["ORACLES", "QUERIES"]

_NAMES = {
    pages: "page_title page_parts page_router page_lang page_canonical_url page_summary page_block_counts page_blocks_native page_body_score page_links text_normalize text_canonical "
    "text_useful html_escape_decode strip_html filename_sanitize doc_dedup_first doc_line_dedup_first doc_contained_dup pipe_line_split code_language_score tex_detect page_dom_blocks page_nested_lists page_body_top1 doc_contained_dup_exact",
    relations: "event_merge_runs event_next_gap conv_fallback_zip count_by count_by_unknown top1_candidate topk_images first_wins_index last_wins_index media_lookup_left "
    "post_lookup_left fallback_coalesce_join semi_labeled anti_labeled asof_before_after interval_containment union_keep_distinct running_cap weighted_avg min_nearest "
    "separator_collapse props_json_extract request_correlate session_quiescence rolling_upsert session_windows",
    built: "payload_walk payload_json_strings article_candidates media_index formula_index post_index articles article_blocks draft_lists completeness render_html page_documents page_document_blocks "
    "page_linked_articles page_post_roots page_embedded_posts page_media page_cards page_polls page_authors page_titles page_tables page_kinds block_copies block_code_runs block_pseudo_lists markdown_blocks "
    "formula_normalize code_languages clean_titles text_typography sanitize_html media_urls images_largest anchors_nearest media_inventory cover_detect time_nearest blocks_in_order captured_near capture_responses stopped_sessions",
    literals: "diagnostics_json draft_inline line_kind_classify pseudo_list_groups",
}

QUERIES = {name: getattr(module, name) for module, names in _NAMES.items() for name in names.split()} | capture.QUERIES
ORACLES = {**sql.ORACLES, **built_sql.ORACLES, **capture.ORACLES}
