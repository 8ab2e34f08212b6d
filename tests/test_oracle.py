"""Every registered query against its SQL twin, or for shape without one."""

import pytest
from conftest import SF_DIR
from oracle_check import compare

from docspark.plans import PLANS

TRAINING = {
    "m08_train_text_classifier", "m09_train_linear_svc",
    "m10_train_entity_augmented", "m12_reclassify_other", "m18_compare_models"}


@pytest.mark.parametrize("name", [n for n in PLANS if n not in TRAINING])
def test_query_matches_sql(spark, oracle, name):
    problem, _ = compare(spark, oracle, PLANS[name], SF_DIR)
    assert problem is None, problem


def test_names_and_twins():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(PLANS) - set(entry.oracle_sql())
    assert without <= TRAINING | {
        "x14_annotate_spans", "m17_annotator_agreement", "s08_export_annotations", "g02_span_rows"}
