"""The same results when nothing may be broadcast (the path taken by tables too big to send)."""

import pytest

from conftest import SF_SMALL
from lectern.plans.queries import queries

NAMES = ["holdout_stratified", "kfold_stratified", "cv_results", "learning_curve_metrics",
         "review_prevalence", "token_ids"]


def collect(spark, name):
    return sorted(map(tuple, queries()[name](spark, SF_SMALL).collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_shuffle_joins_give_same_result(spark, name):
    expected = collect(spark, name)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert collect(spark, name) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
