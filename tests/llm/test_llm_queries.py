import pytest

import corpus_pipeline
from quern.llm.queries import ORACLE, QUERIES
from tests.against_sql import SF, check, database


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name], database())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_a_row_for_every_document_or_page(spark, name):
    found = QUERIES[name](spark, SF)
    key = "page_id" if "page_id" in found.columns else "doc_id"
    table = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    ids = {r[0] for r in found.select(key).collect()}
    assert ids == {r[0] for r in table.select(key).collect()}


def test_run_is_the_stages_in_turn(spark):
    assert {"sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SF).columns)
