"""Queries that compare groups make the counts once, however many statistics read them, and rank without meeting values again."""

import pytest
from pyspark.sql import functions as F

from cytoloom.operators import markers
from cytoloom.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["audit_flags", "audit_markers", "panel_candidates", "marker_gate", "evidence_packet"])
def test_counts_are_made_once(spark, monkeypatch, name):
    made, counts = [], catalogue.counts
    monkeypatch.setattr(catalogue, "counts", lambda *a: made.append(1) or counts(*a))
    catalogue.QUERIES[name](spark, D)
    assert len(made) == 1 + (name == "evidence_packet")  # its medians read them too


def test_ranks_need_no_join_by_value(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "a", 2.0), (1, "b", 3.0), (4, "a", 5.0)], "cell_id long, gene string, v double")
    groups = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q"), (4, None), (5, "p")], "cell_id long, grp string")
    out = markers.rank_sum(x, groups)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
    got = {(r.gene, r.grp): r.z for r in out.collect()}
    # of a: ranks of the values 1, 1, 2, 5 over one zero are 2.5, 2.5, 4, 5; p has 1 and the zero, q has 1 and 2
    n, z = 5.0, lambda ranks, m: (ranks - m * 6 / 2) / (m * (n - m) * 6 / 12) ** 0.5
    assert got["a", "p"] == pytest.approx(z(2.5 + 1, 2)) and got["a", "q"] == pytest.approx(z(2.5 + 4, 2))
    assert got["b", "p"] == pytest.approx(z(5 + 2.5, 2)) and got["b", "q"] == pytest.approx(z(2 * 2.5, 2)) and ("b", None) in got
    many = markers.counted(x, groups)
    assert sorted(map(str, markers.rank_sum(None, groups, many).collect())) == sorted(map(str, out.collect()))
    one, two = (sorted(map(str, markers.fractions_and_change(*a, many=m).where(F.col("grp").isNotNull()).collect())) for a, m in (((x, groups), None), ((None, groups), many)))
    assert one == two
