"""Every query of the library, by name, with the SQL that checks it.

The queries read the driver's tables as stand-ins: ``events`` are visits and
feed items, ``documents`` are indexed texts, ``pages`` are web pages and
``conversations`` are threads of posts.
"""

from __future__ import annotations

from tomespark.plans import pages, reading, tables, talks, texts, upkeep

QUERIES = {**reading.QUERIES, **texts.QUERIES, **talks.QUERIES, **pages.QUERIES, **tables.QUERIES, **upkeep.QUERIES}
ORACLE_SQL = {**reading.SQL, **texts.SQL, **talks.SQL, **pages.SQL, **tables.SQL, **upkeep.SQL}
