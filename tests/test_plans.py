"""Physical-plan properties that matter at scale."""

import re

from spendsignals.plans import inputs as I
from spendsignals.plans.catalog import queries

from conftest import SF_SMALL


def _executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_windows_share_one_user_exchange(spark):
    plan = _executed(queries()["p10_engineered_table"](spark, SF_SMALL))
    shuffles = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)
    assert shuffles == ["hashpartitioning"], shuffles
    assert "hashpartitioning(user_id" in plan
    assert len(re.findall(r"(?<![A-Za-z])Window \[", plan)) >= 2


def test_user_aggregate_reuses_window_partitioning(spark):
    from spendsignals.operators.risk import user_profile
    plan = _executed(user_profile(I.scored(spark, SF_SMALL)))
    # one user exchange for windows + aggregate; the only other one carries the one-row max time
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", plan)) == 1, plan


def test_filter_pushed_to_scan_without_shuffle(spark):
    plan = _executed(queries()["f01_filter_eq"](spark, SF_SMALL))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan)[1]
    assert pushed, plan
    assert "Exchange hashpartitioning" not in plan
