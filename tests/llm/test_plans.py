"""Plans that the driver holds: no branch for hot groups where there are none, small steps; what is shuffled, and how long it stays."""

import random

from pyspark.sql import functions as F

from tidemark.llm import common, ngramjoin
from tidemark.llm.common import components, join_hot, written


def test_no_branch_without_hot_groups(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    every = written(df.groupBy("k").agg(F.count(F.lit(1)).alias("c")), "test")
    rare = df.where("k > 0")
    plain, both = join_hot(rare, every.where("k > 0"), ["k"], 5000), join_hot(df, every, ["k"], 5000)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan(plain) and "Union" in plan(both)
    assert plain.count() == 2000 and both.count() == 5000 and both.where("c = 3000").count() == 3000


def test_shuffle_files_go_with_their_write(spark, monkeypatch):
    """The setting holds while a step is written, and only then."""
    spark.conf.unset(common.CLEAN_UP)
    seen, kind = [], type(spark.range(1))
    write = kind.write.fget
    monkeypatch.setattr(kind, "write", property(lambda self: seen.append(spark.conf.get(common.CLEAN_UP)) or write(self)))
    assert written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test").count() == 7
    assert seen == ["true"] and spark.conf.get(common.CLEAN_UP, "false") == "false"


def test_only_texts_of_the_trie_are_joined_and_none_is_shuffled(spark, monkeypatch):
    ids = [0, 1, 7, 8, 32766, 32767, 32768, 32769, 65536, 65537, 3 << 33, (3 << 33) + 32768, (5 << 33) + 77]
    texts = spark.createDataFrame([(i, b"%d" % i) for i in ids], "id long, t binary")
    plans = []
    monkeypatch.setattr(ngramjoin, "written", lambda df, what: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    for k in range(3):
        picked = random.Random(k).sample(ids, 6)
        made = ngramjoin.texts_of(spark.createDataFrame([(i,) for i in picked * 2], "id long"), texts)
        assert sorted((r["id"], bytes(r["t"])) for r in made.collect()) == sorted((i, b"%d" % i) for i in picked)
    assert all("broadcast" in p for p in plans)


def test_components_in_small_plans(spark, monkeypatch):
    """A round's steps are plans of their own, also where a node has most edges."""
    lengths = []

    def noted(df, what):
        lengths.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return written(df, what)

    monkeypatch.setattr(common, "written", noted)
    edges = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(2000, 2040)] + [(5000, 4999)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1500)} | {i: 2000 for i in range(2000, 2041)} | {4999: 4999, 5000: 4999}
    assert max(lengths) < 30
