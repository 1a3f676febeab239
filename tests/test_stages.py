"""What a recommendation keeps in shared storage."""

import os
import time

from stallwise.operators.competitive import profiles
from stallwise.operators.prices import staged_state
from stallwise.operators.recommend import Parts
from stallwise.sources.roles import load_roles
from stallwise.sources.staging import Stages


def test_stages_that_nothing_reads_any_more_are_gone_before_the_answer(spark):
    p = Parts(load_roles(spark, "/root/testdata/sf0.001"))
    held = set(os.listdir(p.stages.root.removeprefix("file:")))
    assert held == {"state", "prices", "coverage", "members"}
    assert not {"seq", "selling", "sale_label"} & set(p.state.columns)
    assert p.members.count() > 0 and p.coverage.count() > 0


def test_what_was_shuffled_for_a_stage_is_gone_when_it_is_written(spark):
    jvm = spark.sparkContext._jvm
    files = lambda: {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    default = spark.conf.get(setting)
    made = Stages(spark).put("sums", spark.range(1000).repartition(7).groupBy("id").count())
    until = time.monotonic() + 10
    while (left := files() - before) and time.monotonic() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(setting) == default and made.count() == 1000


def test_reviews_are_gathered_once_for_profiles(spark):
    r = load_roles(spark, "/root/testdata/sf0.001")
    plan = profiles(r, staged_state(r))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trunc(") == 1
