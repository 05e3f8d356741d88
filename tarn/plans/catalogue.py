"""All registered queries: name -> (function of session and folder, SQL for the same rows or None)."""

from . import building, ledger, operations, retrieval, reviews

CATALOGUE = {**retrieval.QUERIES, **operations.QUERIES, **ledger.QUERIES, **reviews.QUERIES, **building.QUERIES}
