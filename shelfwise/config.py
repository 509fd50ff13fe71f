"""Settings shared by all jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class InsightConfig:
    """What the jobs compute and how the catalog-wide steps are spread.

    fallback_to_rules
        Use rule texts and rule pairings where no usable reply exists.
    max_results
        Alternatives kept per product.
    page_size
        Candidates taken per category, most scanned first.
    category_depth
        How many category levels of a product are searched, specific to broad.
    shards
        First-stage groups per category when the most scanned products are
        picked. A category holding a large part of the catalog is reduced in
        this many tasks before one task sees what is left of it.
    path_rows
        Products of one category path that are compared under one key. Paths
        with more are dealt out over several.
    pool_products
        Products a category path must have to get a candidate list of its own.
        Products of other paths put theirs together from the lists of their categories.
    """

    fallback_to_rules: bool = False
    max_results: int = 5
    page_size: int = 50
    category_depth: int = 3
    shards: int = 64
    path_rows: int = 50_000
    pool_products: int = 16


DEFAULT_CONFIG = InsightConfig()
