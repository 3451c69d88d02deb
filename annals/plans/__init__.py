"""Registered queries and their SQL."""

from annals.plans import canon_queries, catalog_queries, corpus, debate_queries, dense_queries, dossier_queries, events, extracts, facts, mine_queries, person_queries, phrase_queries, read_queries, record_queries, store_queries, title_queries

PARTS = (events, corpus, extracts, facts, title_queries, person_queries, mine_queries, read_queries, dense_queries, debate_queries, dossier_queries, catalog_queries, phrase_queries, canon_queries, record_queries, store_queries)
QUERIES = {name: q for part in PARTS for name, q in part.QUERIES.items()}
SQL = {name: q for part in PARTS for name, q in part.SQL.items()}
