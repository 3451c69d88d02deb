"""Every registered query of the reference tables against its SQL, at the smallest size."""

import pytest
from oracle import compare

from annals import plans

SF = "/root/testdata/sf0.001"


#: What a query decides; one value in all rows would hide a rule that never fires.
DECIDING = {
    "judge_verdicts": "verdict", "claim_kind_classify": "kind", "time_parse": "year", "year_last_in_window": "year", "place_plausible": "plausible", "place_text_best": "place", "occurrence_dedup": "support",
    "competing_places": "places", "gate_decisions": "status", "event_stage": "outcome", "event_table": "status", "competing_abstention": "conflict", "debate_facts": "proposition", "filter_score_fragments": "accepted",
    "place_alias_resolution": "event_type", "human_entities": "is_new", "claims_by_confidence": "confidence", "exploration_reachable": "depth", "exploration_whole": "depth", "extract_phrases": "verb", "status_updates": "active",
    "claims_backfill": "locator", "claim_relations": "relation", "graph_fingerprints": "n_atoms", "thesis_records": "problem", "thesis_contributions": "role", "deposit_records": "problem", "library_notices": "problem",
    "harvested_articles": "token", "match_subject_documents": "relation", "person_search_score": "score", "mention_resolution": "mention_role", "geocode_applied": "geocoded", "kind_conditional_upsert": "kind",
    "mine_candidates": "extractor", "dump_plan_counts": "plan", "typed_dates": "month",
}


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, plans.QUERIES[name], plans.SQL[name], DECIDING.get(name)) > 0, "no rows"
