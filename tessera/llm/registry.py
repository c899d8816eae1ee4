"""Queries of the corpus operators, and their SQL where SQL can express them."""

from tessera.llm import audit, chat, classifier, codes, licences, mixing, nbest, neighbours, quality, records, revisits, simhash, wrappers

MODULES = (revisits, quality, chat, licences, wrappers, neighbours, mixing, simhash, records, nbest, classifier, codes, audit)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
