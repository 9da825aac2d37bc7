"""Names of the engine's queries and the SQL that checks them."""

from __future__ import annotations

from gleaner.plans import files, records, review


def queries():
    return {**files.QUERIES, **review.QUERIES, **records.QUERIES}


def oracle_sql():
    return {**files.SQL, **review.SQL, **records.SQL}
