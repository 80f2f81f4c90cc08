"""Every registered query of the engine, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from plumbline.plans import answer_plans, archive_plans, attribute_plans, case_plans, chat_plans, contest_plans, dataset_plans, decision_plans, gap_plans, keyword_plans, listing_plans, live_plans, monitor_plans, page_plans, peer_plans, price_plans, profile_plans, record_plans, source_plans, stream_plans, text_plans, value_plans, visibility_plans

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for plans in (price_plans, visibility_plans, peer_plans, text_plans, attribute_plans, case_plans, answer_plans, dataset_plans, monitor_plans, stream_plans, source_plans, value_plans, record_plans, gap_plans, page_plans, decision_plans, archive_plans, chat_plans, listing_plans, keyword_plans, profile_plans, live_plans, contest_plans):
    QUERIES |= plans.QUERIES
    ORACLE_SQL |= plans.ORACLE_SQL
