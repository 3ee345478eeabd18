"""Registered queries next to their SQL on the smallest tables."""

import os

import pytest

from skillgrid.plans import catalog
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
PICKS = ("B4_advert_sections", "C4_classify_skill", "D2_phrase_hits", "F2_skill_gap", "G4_document_frequency", "H2_score_buckets",
         "H11_skill_correlation", "I7_upserted_aliases", "K6_span_scores", "L3_retrieval", "M7_page_modules", "A9_upsert", "N1_continuous_ingest")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", PICKS)
def test_query_matches_sql(spark, name):
    con = duck(SF)
    ok, note = compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql().get(name), SF)
    assert ok, note


def test_every_sql_text_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
