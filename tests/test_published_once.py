"""Published rows are worked out once, however often a publication reads them."""

from episodium.plans import dataset_queries as dq


def test_rows_are_settled_before_they_are_published(spark, monkeypatch):
    settled = []
    keep = dq.settle
    monkeypatch.setattr(dq, "settle", lambda rows, purpose="settled": settled.append(rows.columns) or keep(rows, purpose))
    dq.s10_published(spark, "/root/testdata/sf0.001")
    assert ["idx", "task", "seed", "split"] in settled
