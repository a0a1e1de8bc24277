"""Records dealt by pair, and tasks that become more with the table."""

import re

from likeness.operators import calls as C
from likeness.sources import tables as T


def exchanges(df):
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def records(spark):
    exact = spark.createDataFrame([(i % 40, i % 3, "A", str(i % 2), 4.0 + i % 5 / 10) for i in range(400)],
                                  "entity long, target long, type string, ach string, potency double")
    return exact, spark.createDataFrame([(i % 50, 1, 4.0) for i in range(90)], "entity long, target long, bound double")


def test_calls_are_dealt_once(spark):
    assert exchanges(C.activity_calls(*records(spark))) == 2  # exact and censored records; before, each step dealt anew


def test_tasks_become_more_with_the_table(spark, monkeypatch):
    exact, censored = records(spark)
    whole = sorted(map(tuple, C.activity_calls(exact, censored).collect()))
    assert T.tasks_for(exact, censored) is None
    monkeypatch.setattr(T, "TASK_ROWS", 20)
    assert T.tasks_for(exact, censored) == 20
    assert T.dealt(exact, T.tasks_for(exact), "entity", "target").rdd.getNumPartitions() == 20
    assert sorted(map(tuple, C.activity_calls(exact, censored).collect())) == whole
