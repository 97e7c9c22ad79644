"""Spark takes exploded tokens for as small as the file of strings: a join with them must not leave it to broadcast them to the driver."""

import re

import __spark_entry__ as entry
import pytest

from actlens.operators import profile

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["act_distribution", "act_histogram", "token_preference", "token_preference_summary", "token_role_preference", "token_role_summary", "token_inverse_samples", "token_preference_inverse"])
def test_tokens_are_merged_not_broadcast(spark, name, monkeypatch):
    monkeypatch.setattr(profile, "settle", lambda df: df)  # one plan that shows all joins
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10_000_000  # Spark's default
    for query in (name, f"{name}_whole"):
        df = entry.queries()[query](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        join = r"\w*Join(?:\(skew=true\))? \[sample_idx#\d+L, token_idx#\d+\], \[sample_idx#\d+L, token_idx#\d+\], Inner"
        assert {m.split(" ")[0] for m in re.findall(join, plan)} == {"SortMergeJoin"}
