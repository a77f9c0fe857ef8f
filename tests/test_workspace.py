"""Folders of settled tables."""

import os

from episodium import workspace


def test_a_step_leaves_its_result_alone(spark, tmp_path):
    root = workspace.shared_root(spark) + "/episodium"
    kept = workspace.settle(spark.range(3), "kept")

    def rows():
        one = workspace.settle(spark.range(10), "on-the-way")
        return workspace.settle(one.where("id > 4"), "on-the-way").union(kept)

    result = workspace.step(spark, rows, "result")
    assert result.count() == 8 and kept.count() == 3
    names = os.listdir(root.removeprefix("file://").removeprefix("file:"))
    assert any(n.startswith("result-") for n in names) and not any(n.startswith("on-the-way") for n in names)
    workspace.discard(spark, str(tmp_path / "nothing"))
