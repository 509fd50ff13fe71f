"""Insights on packaged foods as Spark jobs over a product catalog."""

from shelfwise.config import InsightConfig
from shelfwise.plans.jobs import (
    alternatives,
    analyse,
    explain,
    pair,
    pools,
    prompts,
    report,
    requests_not_found,
    resolve_requests,
    resolved,
    summarise,
)
from shelfwise.operators.prompt_versions import current_replies, unanswered, with_hash
from shelfwise.operators.rule_tables import fixed_rules
from shelfwise.operators.shelf_index import build_index, compact_index, indexed_top, update_index
from shelfwise.sources.readers import (
    accepted,
    latest_versions,
    read_catalog,
    read_catalog_lines,
    read_replies,
    read_requests,
    read_responses,
    rejected,
    repeated_barcodes,
)
from shelfwise.sources.sinks import Staging, write_checked, write_resolved
from shelfwise.sources.snapshots import FolderTable
from shelfwise.streaming.views import (
    compact_latest_viewed,
    latest_viewed,
    read_latest_viewed,
    start_latest_viewed,
)

__all__ = [
    "FolderTable",
    "InsightConfig",
    "Staging",
    "accepted",
    "alternatives",
    "analyse",
    "build_index",
    "compact_index",
    "compact_latest_viewed",
    "current_replies",
    "explain",
    "fixed_rules",
    "indexed_top",
    "latest_versions",
    "latest_viewed",
    "pair",
    "pools",
    "prompts",
    "read_catalog",
    "read_catalog_lines",
    "read_latest_viewed",
    "read_replies",
    "read_requests",
    "read_responses",
    "rejected",
    "repeated_barcodes",
    "report",
    "requests_not_found",
    "resolve_requests",
    "resolved",
    "start_latest_viewed",
    "summarise",
    "unanswered",
    "update_index",
    "with_hash",
    "write_checked",
    "write_resolved",
]
