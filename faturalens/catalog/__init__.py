"""Every registered query with the SQL it is compared with."""

from faturalens.catalog import ingest, log, money, outlook, prompts, text
from faturalens.catalog.registry import Query

ALL: dict[str, Query] = {**money.QUERIES, **outlook.QUERIES, **text.QUERIES, **log.QUERIES, **ingest.QUERIES, **prompts.QUERIES}
