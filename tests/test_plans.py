"""Registered queries: what they return and how often they read their tables."""

import os

import pytest

import __spark_entry__ as entry
from urbanflow.plans import factors
from urbanflow.plans import places as PP
from urbanflow.plans import views as V

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def test_divergences_of_all_kinds_are_returned(spark):
    row = entry.queries()["beta_divergence"](spark, FOLDER).first()
    assert set(row.asDict()) == {"beta0", "beta0_infinite", "beta1", "beta2", "beta15"}
    assert row.beta15 == entry.queries()["beta_divergence_dense"](spark, FOLDER).first().beta15
    assert row.beta15 > 0 and "AS beta15" in entry.oracle_sql()["beta_divergence"]


def test_edges_are_computed_once(spark, monkeypatch):
    rows = spark.sparkContext.accumulator(0)
    found = V.edges(spark, FOLDER)

    def seen(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch
    monkeypatch.setattr(V, "edges", lambda *_: found.mapInPandas(seen, found.schema))
    numbered, entities, relations = factors._edges(spark, FOLDER)
    assert numbered.count() == found.count() == rows.value
    assert entities == 25 and relations == found.select("k").distinct().count()


@pytest.mark.parametrize("name", ["kruskal_mttkrp", "factor_unpack", "spatial_class"])
def test_lines_are_read_once_by_a_query(spark, monkeypatch, name):
    """The tensor and the factors of a query come from one table of counts."""
    read, counts = [], V.od_counts
    monkeypatch.setattr(V, "od_counts", lambda *a: read.append(1) or counts(*a))
    assert entry.queries()[name](spark, FOLDER).count() > 0
    assert len(read) == 1


def test_both_day_types_share_their_counts(spark, monkeypatch):
    read, counts, given = [], V.od_counts, []
    monkeypatch.setattr(V, "od_counts", lambda *a: read.append(1) or counts(*a))
    monkeypatch.setattr(factors, "_pairs", lambda spark, folder, day_type, found: given.append(found) or day_type)
    assert factors._cases(spark, FOLDER) == {"workdays": "workdays", "holidays": "holidays"}
    assert len(read) == 1 and given[0] is given[1]


def test_points_meet_places_once(spark, monkeypatch):
    """Both day types, and the sums over places, share one radius join over all points."""
    made, rows = PP._radius_counts(spark, FOLDER), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch
    monkeypatch.setattr(PP, "_radius_counts", lambda *_: made.coalesce(1).mapInPandas(seen, made.schema))
    monkeypatch.setattr(factors, "_pairs", lambda spark, folder, day_type, written: written[1])
    cases = factors._cases(spark, FOLDER)
    assert [len(known.collect()) for known in cases.values()] == [25, 25]
    assert rows.value == 25
