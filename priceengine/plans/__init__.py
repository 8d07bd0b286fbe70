"""Driver queries. Importing this registers all of them."""

from priceengine.plans import archive_queries, catalog_queries, matching_queries, price_queries, state_queries, text_queries  # noqa: F401
from priceengine.plans.registry import QUERIES, SQL  # noqa: F401
