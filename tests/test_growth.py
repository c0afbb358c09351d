"""Plans whose work or memory of one task must not grow faster than the tables."""

from patchloom.plans import analyses, catalogue

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_next_tags_are_looked_up_in_frames_that_grow(spark):
    """Only the few months, not the commits, have a frame that shrinks, which is summed up anew for every row."""
    plan = _plan(analyses.q13_descriptions(spark, SF))
    assert all("month" in line for line in plan.split("\n") if "unboundedfollowing" in line) and "unboundedpreceding" in plan


def test_pairs_are_counted_where_they_are_made(spark):
    plan = _plan(catalogue.j1_block_exact(spark, SF))
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_tasks_grow_with_the_table(spark):
    n = catalogue._t(spark, SF, "lineitem").count()
    assert catalogue._tasks(spark, SF, "lineitem", 10) == -(-n // 10) and catalogue._tasks(spark, SF, "lineitem", n) == 4
    for q in (analyses.j12_committer_correct, analyses.j13_committer_near, analyses.q10_upstream_table):
        assert "RepartitionByExpression" in _plan(q(spark, SF))
