"""Role, format and master predicates on the parity cases."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators import formats
from quillgraph.policies import Policy
from tests.model import album, model

P = Policy()
CASES = [  # role, ineligible, performer credit, performer role, primary category
    (None, False, True, False, "unknown"), ("", False, True, False, "unknown"), ("Guitar", False, True, True, "strings"), ("Guitar [12-String]", False, True, True, "strings"),
    ("Written-By", True, False, False, "composition"), ("Written-By, Producer", False, False, False, "composition"), ("Producer", False, False, False, "production"),
    ("Samples", True, True, False, "unknown"), ("Performer [Samples From]", True, True, False, "unknown"), ("Sampler [Fairlight]", False, True, False, "unknown"),
    ("Design, Lead Vocals", False, True, True, "packaging_business"), ("Mixed By", False, False, False, "engineering"), ("Kazoo", False, True, False, "unknown"), ("Remix, Drums", False, True, True, "rework"),
]


def test_roles(spark):
    r = F.col("role")
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, role string")
    got = df.select("i", R.edge_ineligible(r, P), R.performer_credit(r, P), R.performer_role(r, P), R.primary_category(R.role_categories(r, P))).orderBy("i").collect()
    assert [tuple(x)[1:] for x in got] == [c[1:] for c in CASES]


def test_category_order_and_display(spark):
    r = F.col("role")
    df = spark.createDataFrame([("Producer, Guitar, Thing, Engineer",), ("Bass Guitar [Fretless]",)], "role string")
    got = df.select(R.role_categories(r, P).alias("c"), R.performer_category(r, P).alias("p"), R.instrument_role(r, P, ["bass", "drums"]).alias("rhythm")).collect()
    assert list(got[0].c) == ["production", "strings", "unknown", "engineering"] and (got[0].p, got[1].p) == ("guitar", "bass") and (got[0].rhythm, got[1].rhythm) == (False, True)


@pytest.mark.parametrize(
    "descriptions, title, want",
    [([], None, "review"), (["Album"], "A", "allow"), (["Album", "Compilation"], "A", "exclude"), (["LP"], "A", "review"), (["Album"], "Live At Home", "review"), (["  album "], "A", "allow")],
)
def test_format_policy(spark, descriptions, title, want):
    m = model(spark, album(1, [1, 2]), releases=[(1, title, "UK", "1990", 1, True, "ok")], formats=[(1, 0, "Vinyl", descriptions)] if descriptions else [])
    assert formats.format_policy(m, P).collect()[0].decision == want


def test_masters_and_years(spark):
    df = spark.createDataFrame([(["Rock"], ["Score"], "1999-00-00"), (["Stage  & Screen"], [], "99"), (None, None, None)], "g array<string>, s array<string>, d string")
    got = df.select(R.non_studio_master(F.col("g"), F.col("s"), P), R.year_of(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(True, 1999), (True, None), (False, None)]
