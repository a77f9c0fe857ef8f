"""Folders of raw episodes, whole and broken, and crops of packed frames."""

import json
import random

import numpy as np
import pytest

from episodium import dims
from episodium.operators import crops
from episodium.sources.raw_episodes import folder_names, read_raw_episodes

POSE = {"pose0_position": [0.1, 0.2, 0.3], "pose0_rotation": [0, 0, 0, 1], "pose1_position": [0.4, 0.5, 0.6], "pose1_rotation": [0, 0, 1, 0]}


def write(root, task, name, n_actions=2, n_obs=3, **files):
    content = {
        "trajectory": {
            "steps": n_actions, "success": True, "seed": 7, "end_effector_type": "suction", "prompt": "Put it there.",
            "prompt_assets": {"base_obj": [{"name": "bowl", "texture": "red"}]},
            "obj_id_to_info": {"4": {"obj_name": "bowl", "obj_assets": "bowl/x", "texture_name": "red"}},
        },
        "actions": {k: [v] * n_actions for k, v in POSE.items()},
        "observations": [{"index": n_obs - 1 - i, "front": f"f{i}", "top": f"t{i}"} for i in range(n_obs)],
        **files,
    }
    folder = root / task / name
    folder.mkdir(parents=True)
    for kind, value in content.items():
        if value is not None:
            (folder / f"{kind}.json").write_text(value if isinstance(value, str) else json.dumps(value))


def test_raw_episodes(spark, tmp_path):
    aliases = [n for n in folder_names(["sweep_without_exceeding"]) if n != "sweep_without_exceeding"]
    assert aliases
    write(tmp_path, "sweep_without_exceeding", "000001")
    write(tmp_path, aliases[0], "000002", n_obs=2)
    write(tmp_path, "rotate", "000003", n_obs=5)
    write(tmp_path, "rotate", "000004", trajectory="{broken")
    write(tmp_path, "rotate", "000005", actions=None)
    write(tmp_path, "rotate", "000006", actions={**{k: [v] for k, v in POSE.items()}, "pose1_rotation": []})
    write(tmp_path, "rotate", "x7")
    write(tmp_path, "no_such_task", "000008")
    rows = {r["name"]: r for r in read_raw_episodes(spark, str(tmp_path)).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        "000001": "ok", "000002": "ok", "000003": "observations and actions differ", "000004": "broken trajectory",
        "000005": "no actions", "000006": "uneven actions", "x7": "bad index", "000008": "unknown task",
    }
    one = rows["000001"]
    assert one["task"] == rows["000002"]["task"] == dims.TASKS["sweep_without_exceeding"]
    assert [o["index"] for o in one["observations"]] == [0, 1, 2] and one["idx"] == 1
    assert [a["index"] for a in one["pose_actions"]] == [0, 1] and one["pose_actions"][1]["pose1_position"] == [0.4, 0.5, 0.6]
    assert one["object_metadata"][0].asDict() == {"obj_id": 4, "obj_name": "bowl", "obj_asset_name": "bowl/x", "texture_name": "red"}
    assert one["prompt_assets"]["base_obj"][0]["texture"] == "red"

    few = read_raw_episodes(spark, str(tmp_path), ["sweep_without_exceeding"])
    assert {r["name"] for r in few.collect()} == {"000001", "000002"}
    assert not any("rotate" in f or "no_such" in f for f in few.inputFiles())  # never listed
    assert read_raw_episodes(spark, str(tmp_path), ["twist"]).count() == 0


def plain_resize(image, size):
    """Overlap-weighted mean of one channel, pixel by pixel; only for shrinking."""
    side, out = len(image), np.zeros((size, size))
    scale = side / size
    for y in range(size):
        for x in range(size):
            for j in range(side):
                for i in range(side):
                    v = max(0, min(j + 1, (y + 1) * scale) - max(j, y * scale))
                    h = max(0, min(i + 1, (x + 1) * scale) - max(i, x * scale))
                    out[y, x] += image[j][i] * v * h / scale**2
    return out


def test_resize_weights():
    for side in (1, 2, 3, 5, 8, 31, 32, 33, 64, 100):
        for size in (1, 3, 4, 32):
            weights = crops.resize_weights(side, size)
            assert weights.shape == (size, side) and np.allclose(weights.sum(1), 1) and (weights >= 0).all()
    image = np.random.default_rng(1).random((7, 7))
    w = crops.resize_weights(7, 3)
    assert np.allclose(w @ image @ w.T, plain_resize(image, 3))
    assert np.allclose(crops.resize_weights(2, 4) @ [0.0, 1.0], [0, 0, 1, 1]) or np.allclose(crops.resize_weights(2, 4) @ [0.0, 1.0], [0, 0.5, 1, 1])


def test_crops_of_packed_frames(spark):
    draw = random.Random(2)
    ids = bytes(draw.choice([0, 1, 2, 3, 9]) for _ in range(12 * 10))
    colours = bytes(draw.randrange(256) for _ in range(3 * 120))
    rows = [
        (1, 12, 10, colours, ids, [2, 7, 3]), (2, 12, 10, colours, bytes(120), [2, 3]), (3, 12, 10, colours[:-1], ids, [2]),
        (4, None, 10, colours, ids, [2]), (5, 2, 2, bytes([5] * 12), bytes([4, 4, 0, 0]), [4]), (6, 12, 10, colours, ids, []),
    ]
    schema = "frame long, height int, width int, colours binary, segments binary, objects array<int>"
    got = {r["frame"]: r for r in crops.object_crops(spark.createDataFrame(rows, schema), ["frame"], 4).collect()}
    assert [got[i]["status"] for i in range(1, 7)] == ["ok", "nothing visible", "broken", "broken", "ok", "nothing visible"]
    assert got[1]["ids"] == [2, 3, 7] and got[1]["mask"] == [True, True, False] and got[1]["bbox"][2] == [0, 0, 0, 0]
    assert got[3]["ids"] is None and got[6]["ids"] == []
    assert not np.frombuffer(got[1]["crops"][2], "<f4").any() and len(got[1]["crops"][0]) == 4 * 3 * 16
    # a box of 1 x 2 pixels is padded with a row of zeros to 2 x 2
    crop = np.frombuffer(got[5]["crops"][0], "<f4").reshape(3, 4, 4)
    assert got[5]["bbox"] == [[0, 0, 0, 1]] and crop[:, 0].tolist() == [[5.0] * 4] * 3 and not crop[:, -1].any()
    grid, values = np.frombuffer(ids, np.uint8).reshape(12, 10), np.frombuffer(colours, np.uint8).reshape(3, 12, 10)
    ys, xs = np.nonzero(grid == 2)
    box = values[:, ys.min() : ys.max() + 1, xs.min() : xs.max() + 1].astype(float)
    side = max(box.shape[1:])
    square = np.zeros((3, side, side))
    top, left = (side - box.shape[1]) // 2, (side - box.shape[2]) // 2
    square[:, top : top + box.shape[1], left : left + box.shape[2]] = box
    found = np.frombuffer(got[1]["crops"][0], "<f4").reshape(3, 4, 4)
    assert all(found[c] == pytest.approx(plain_resize(square[c], 4), rel=1e-5) for c in range(3))
