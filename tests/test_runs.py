"""Written tables live as long as their run; a failed fit resumes at its last whole stage."""

import os

import pytest
from pyspark.sql import functions as F

import clausemine as cm
from clausemine.plans import rule_miner
from clausemine.sources.storage import shared_dir, stored

LIVES, BORN, NEAR = ("person", "lives_in", "city"), ("person", "born_in", "city"), ("city", "near", "city")
CONFIG = cm.MinerConfig(sample_size=10, target_edge_type=LIVES, max_attempts=20, max_length=3, min_support=1)


@pytest.fixture(scope="module")
def graph(spark):
    return cm.KnowledgeGraph.from_lists(spark, {"person": 3, "city": 3}, {LIVES: [(0, 1), (1, 2), (2, 0)], BORN: [(0, 0), (1, 1), (2, 2)], NEAR: [(0, 1), (1, 2), (2, 0)]})


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def as_rows(df):
    return sorted(map(str, df.collect()))


def test_nothing_is_left_after_a_run(spark, graph):
    before = tables(spark)
    with cm.RuleMiner(CONFIG) as miner:
        miner.fit(graph)
        assert miner.predict().count() > 0 and miner.results.count() > 0
        assert miner.evaluate_predictions(spark.createDataFrame([(0, 1)], "head_id long, tail_id long")).count() == 3
        assert len(tables(spark) - before) == 1
        miner.fit(graph)  # drops what the first fit wrote
        assert len(tables(spark) - before) == 1 and miner.predict().count() > 0
    assert tables(spark) == before
    with pytest.raises(RuntimeError, match="fit"):
        miner.predict()
    miner.close()


def test_a_failed_fit_resumes_at_its_last_stage(spark, graph, monkeypatch):
    before = tables(spark)
    with cm.RuleMiner(CONFIG) as miner:
        want = as_rows(miner.fit(graph).results)

    def fails(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as broken, pytest.raises(OSError, match="lost"):
        broken.setattr(rule_miner, "evaluate_batch", fails)
        with cm.RuleMiner(CONFIG, run="resumed") as miner:
            miner.fit(graph)
    assert tables(spark) - before == {"run-resumed"}
    for done in ("sample_triples", "random_walks", "distinct_rules", "EdgeIndex"):
        monkeypatch.setattr(rule_miner, done, fails)
    with pytest.raises(ValueError, match="other settings"):
        cm.RuleMiner(cm.MinerConfig(target_edge_type=LIVES), run="resumed").fit(graph)
    with cm.RuleMiner(CONFIG, run="resumed") as miner:
        assert as_rows(miner.fit(graph).results) == want and miner.predict().count() > 0
    assert tables(spark) == before


def test_a_run_holds_tables_written_inside_it(spark):
    before = tables(spark)
    with cm.Run(spark) as run:
        with cm.Run(spark) as inner:
            assert stored(spark.range(3), "numbers").agg(F.sum("id")).first()[0] == 3 and inner.path != run.path
        assert stored(spark.range(4), "numbers").count() == 4
        assert run.stage("kept", lambda: spark.range(5)).count() == 5
        assert run.stage("kept", lambda: spark.range(9)).count() == 5
        assert len(tables(spark) - before) == 1
    assert tables(spark) == before
    outside = stored(spark.range(2), "numbers")
    assert outside.count() == 2 and len(tables(spark) - before) == 1
