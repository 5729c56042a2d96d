"""Queries make no more rows on the way than their inputs and results call for."""

from pyspark.sql import functions as F

from quillgraph.operators import analyses, rank
from quillgraph.policies import Policy
from tests.model import album, model

P = Policy()


def most_rows(df, metric="numOutputRows"):
    """The result, and the most rows that any step of the plan that ran gave (or what other metric is named)."""
    rows = df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        found = plan.metrics().get(metric)
        own = found.get().value() if found.isDefined() else 0
        kids = plan.children()
        return max([own, *(walk(kids.apply(i)) for i in range(kids.size()))])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_resolution_makes_no_row_for_each_release_of_a_title(spark):
    m = model(spark, [c for i in range(1, 61) for c in album(i, [100])], releases=[(i, "Same", "UK", "1990", 900, i == 7, "ok") for i in range(1, 61)])
    candidates = spark.createDataFrame([(i, None, " same", "ALICE ") for i in range(100)] + [(100, 3, "other", "nobody")], "position long, release_hint long, title string, artist string")
    rows, most = most_rows(rank.resolve_candidates(m, candidates, P))
    assert [tuple(r) for r in rows] == [(0, "text", 7, 100)]
    assert most <= 300
    hinted = rank.resolve_candidates(m, candidates.where(F.col("position") == 100), P).collect()
    assert [tuple(r) for r in hinted] == [(100, "hint", 7, 100)]


def test_pairs_of_a_group_are_not_shuffled(spark):
    """100 members of one group, 30 of them also in a second one with a member of its own."""
    groups = [(i, 1) for i in range(100)] + [(i, 2) for i in range(30)] + [(200, 2), (300, 3)]
    df = spark.createDataFrame(groups, "artist_id long, group_id long")
    want = sorted({(a, b) for a, g in groups for b, h in groups if g == h and a < b})
    rows, most = most_rows(analyses.family_pairs(df), "shuffleRecordsWritten")
    assert sorted(map(tuple, rows)) == want
    assert most <= 900  # 2 x 435 pairs of the 30, once for each group, and no more
    assert sorted(map(tuple, analyses.family_pairs(df, part=7).collect())) == want
