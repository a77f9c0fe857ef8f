"""Operators against plain Python on small fixtures, edge cases included."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from episodium import dims
from episodium import vocabulary as V
from episodium.functions import pose as P
from episodium.functions import text as X
from episodium.operators import actions as ac
from episodium.operators import datasets as ds
from episodium.operators import evaluation as ev
from episodium.operators import goals as go
from episodium.operators import prompts as pr
from episodium.operators import runs as ru
from episodium.operators import scene as sc
from episodium.operators import sequences as sq

TRACKERS = {
    1: [False, True, False, True, False],
    2: [True],
    3: [False, False],
    4: [True, False, False, False],
    5: [False, True, True],
}


def steps(spark):
    return spark.createDataFrame(
        [(i, t, s) for i, tracker in TRACKERS.items() for t, s in enumerate(tracker)],
        "idx bigint, t bigint, success boolean",
    )


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_hesitance_and_flailing(spark):
    hesitance = {r["idx"]: r["hesitance"] for r in ev.hesitance(steps(spark)).collect()}
    flailing = {r["idx"]: r["flailing"] for r in ev.flailing(steps(spark)).collect()}
    for idx, tracker in TRACKERS.items():
        if True not in tracker:
            assert hesitance[idx] is None and flailing[idx] is None
            continue
        after = tracker[tracker.index(True) + 1 :]
        assert hesitance[idx] == (after.count(False) / len(after) if after else 0)
        assert flailing[idx] == pytest.approx(math.tanh(math.log(len(after))) if after else 0)


def test_final_success_of_episode_without_steps(spark):
    headers = spark.createDataFrame([(i,) for i in [*TRACKERS, 9]], "idx bigint")
    got = {r["idx"]: r["final_success"] for r in ev.final_success(headers, steps(spark)).collect()}
    assert got == {**{i: t[-1] for i, t in TRACKERS.items()}, 9: False}


def test_strict_success_keeps_unknown_limits(spark):
    rows = spark.createDataFrame(
        [(True, None, 3), (False, None, 3), (True, 3, 3), (True, 2, 3)],
        "is_successful_at_end boolean, time_limit bigint, steps_taken bigint",
    )
    assert [r["strict"] for r in ev.with_strict_success(rows).collect()] == [None, False, True, False]


def test_termination_reasons(spark):
    rows = spark.createDataFrame(
        [(1, 0, "x", False), (1, 1, "pointless", True), (1, 2, "x", True), (2, 0, "failed", True), (2, 1, "x", True),
         (3, 0, "x", True), (3, 1, "x", False), (4, 0, "x", False), (4, 1, "x", False), (4, 2, "x", False)],
        "idx bigint, t bigint, kind string, success boolean",
    )
    kept = ev.terminate(rows, 2, F.col("kind") == "pointless", F.col("kind") == "failed")
    got = {(r["idx"], r["t"]): r["recorded"] for r in kept.collect()}
    assert got == {(1, 0): False, (1, 1): None, (2, 0): False, (3, 0): True, (4, 0): False, (4, 1): False}


def test_report_average_differs_from_macro_average(spark):
    rows = spark.createDataFrame([(1, 0, 0.12345), (1, 1, 0.12355), (1, 2, None)], "partition int, task int, s double")
    got = ev.report_average(rows, "s").first()
    assert (got["tasks"], float(got["average"])) == (2, 12.4)


def test_rounding_goes_to_the_even_digit(spark):
    row = one(spark, a=ev.rounded_percent(F.lit(0.1225)), b=ev.rounded_percent(F.lit(0.1235)))
    assert (float(row["a"]), float(row["b"])) == (12.2, 12.4)


def test_histogram_fills_empty_bins(spark):
    rows = spark.createDataFrame([(0, 3), (0, 3), (1, 0)], "task int, v bigint")
    got = {(r["task"], r["v"]): r["n"] for r in ev.value_histogram(rows, "task", "v").collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 3): 2, (1, 0): 1}


def test_seeds_repeat_across_tasks(spark):
    tasks = spark.createDataFrame([("a", 0), ("b", 1)], "task string, position int")
    planned = ev.seed_schedule(ev.episode_definitions(tasks, 3), 2).collect()
    assert {(r["task"], r["episode"]): r["seed"] // 999 for r in planned} == {
        ("a", 0): 2, ("a", 1): 3, ("a", 2): 4, ("b", 0): 4, ("b", 1): 6, ("b", 2): 8,
    }
    assert {r["episode"] for r in planned if r["episodes_with_seed"] == 2} == {0, 2}


def test_an_episode_of_any_length_is_one_row(spark):
    rows = spark.range(5000).select(F.lit(1).alias("idx"), F.col("id").alias("t"), (5000 - F.col("id")).alias("v"))
    nested = ds.nest(rows, ["idx"], ["v"], "items")
    got = nested.select(F.transform(ds.sort_records(F.col("items"), "v"), lambda r: r["v"]).alias("v")).collect()
    assert [r["v"] for r in got] == [list(range(1, 5001))]


def test_repeated_rows_change_a_shard(spark):
    from episodium.sources import tables as io

    rows = spark.createDataFrame([(1, 10), (2, 20)], "shard int, v int")
    more = rows.unionByName(rows.where("shard = 1")).unionByName(rows.where("shard = 1"))
    manifest = lambda r: io.shard_manifest(r, io.row_digest("v"), ["shard"])
    got = {r["shard"]: r["decision"] for r in io.shard_decisions(manifest(rows), manifest(more), ["shard"]).collect()}
    assert got == {1: "rewrite", 2: "skip"}


def test_parse_rejects_uneven_episodes(spark):
    headers = spark.createDataFrame([(1,), (2,), (3,)], "idx bigint")
    acts = spark.createDataFrame([(1, 1, 5), (1, 0, 4), (2, 0, 6)], "idx bigint, t bigint, v int")
    got = {r["idx"]: r for r in ds.parse_episodes(headers, acts, acts.where("idx = 1"), ["v"]).collect()}
    assert [a["v"] for a in got[1]["actions"]] == [4, 5]
    assert got[2]["status"] == "reject" and got[2]["actions"] is None
    assert got[3]["status"] == "ok" and got[3]["actions"] == []


def test_split_has_exact_quota_and_is_repeatable(spark):
    rows = spark.range(1000).select(F.col("id").alias("idx"), F.when(F.col("id") < 400, 0).otherwise(1).alias("task"))
    first = ds.stratified_split(rows, 101, "a").collect()
    again = ds.stratified_split(rows.repartition(3), 101, "a").collect()
    assert sorted(first) == sorted(again)
    valid = [r["task"] for r in first if r["split"] == "valid"]
    assert (valid.count(0), valid.count(1)) == (40, 60)


def test_batches_drop_only_the_last(spark):
    rows = spark.range(103).withColumnRenamed("id", "idx")
    kept = ds.shuffled_batches(rows, "idx", 10, "s").collect()
    every = ds.shuffled_batches(rows, "idx", 10, "s", drop_last=False).collect()
    assert len(kept) == 100 and len(every) == 103
    assert {(r["batch"], r["slot"]) for r in kept} == set(itertools.product(range(10), range(10)))


def test_globs_and_precedence():
    assert not ds.matches("l_date", ["l_*"], ["*date"])
    assert ds.matches("l_date", ["l_*"], ["*date"], precedence="include")
    assert ds.matches("anything", None, ["x*"])


def test_enum_decoding(spark):
    ids = dims.TASK_IDS_BY_ANY_NAME
    row = one(
        spark, a=ds.decode_enum(F.lit("sweep"), ids), b=ds.decode_enum(F.lit("16"), ids),
        c=ds.decode_enum(F.lit("juggle"), ids), d=ds.decode_enum(F.lit("99"), ids),
        e=ds.names_for_id(F.lit(11), ids),
    )
    assert (row["a"], row["b"], row["c"], row["d"]) == (11, 16, None, None)
    assert row["e"] == ["sweep_without_exceeding", "sweep"]


def test_flat_columns(spark):
    nested = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b")).alias("a"), F.lit(2).alias("d"))
    assert ds.flatten_struct(nested).columns == ["a.b.c", "d"]


def test_tokens_count_boundaries(spark):
    values = [0.0, 1.0, 0.5, 1e-12, -3.0, 7.0, *[k / 49 for k in range(50)], *[k / 49 + 1e-9 for k in range(49)]]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(P.discretise(F.col("v"), "x").alias("k")).collect()
    for value, row in zip(values, got, strict=True):
        assert row["k"] == sum(k / 49 < value for k in range(50))


def test_tokens_come_back_close(spark):
    values = [(0.25 + i / 200,) for i in range(100)]
    rows = spark.createDataFrame(values, "x double")
    for before, after in zip(values, ac.detokenise(ac.tokenise(rows, {"x": "x"}), {"x": "x"}).collect(), strict=True):
        assert abs(before[0] - after["x"]) < 0.02


def test_loss_of_ignored_axis_drops_the_step(spark):
    rows = spark.createDataFrame(
        [(0, 0, [0.0, 1.0], 1), (0, 1, [0.0, 1.0], -100), (1, 0, [2.0, 0.0], 0), (1, 1, [0.0, 0.0], 1)],
        "step bigint, axis bigint, logits array<double>, target bigint",
    )
    reduced = ac.reduced_loss(ac.fine_grained_loss(rows)).first()
    expected = (math.log(math.exp(2) + 1) - 2 + math.log(2)) / 2
    assert reduced["steps"] == 1 and reduced["loss"] == pytest.approx(expected)


def test_rotation_error_folds_symmetry(spark):
    quarter = math.pi / 2
    row = one(
        spark, a=P.rotation_error(F.lit(0.1), F.lit(quarter), F.lit(quarter)),
        b=P.rotation_error(F.lit(0.0), F.lit(3.0), F.lit(0.0)),
    )
    assert row["a"] == pytest.approx(0.1) and row["b"] == 0


def test_euler_round_trip(spark):
    angles = (0.3, -0.7, 1.1)
    q = P.euler_to_quaternion(*[F.lit(a) for a in angles])
    row = one(spark, **{n: a for n, a in zip("xyz", P.quaternion_to_euler(*q), strict=True)})
    assert tuple(row) == pytest.approx(angles)


def test_crowded_pose_join_equals_plain_join(spark):
    objects = spark.range(300).select(
        (F.col("id") % 3).alias("idx"), F.col("id").alias("t"), (F.col("id") * 7 % 50 / 500.0).alias("x"),
        (F.col("id") * 11 % 40 / 400.0).alias("y"), F.lit(0.0).alias("angle"), F.lit(0.0).alias("symmetry"),
    )
    targets = objects.where("t % 4 = 0").select("idx", F.col("t").alias("k"), (F.col("x") + 0.004).alias("x"), "y", "angle")
    pairs = lambda crowded: sorted(
        (r["t"], r["target_k"]) for r in sc.pose_matches(objects, targets, ["idx"], crowded=crowded).collect()
    )
    points = objects.collect()
    brute = sorted(
        (o["t"], g["t"]) for o in points for g in points
        if g["t"] % 4 == 0 and o["idx"] == g["idx"] and math.sqrt((o["x"] - g["x"] - 0.004) ** 2 + (o["y"] - g["y"]) ** 2) < 0.01
    )
    assert pairs(True) == pairs(False) == brute and brute


def test_first_matching_object_takes_the_target(spark):
    objects = spark.createDataFrame(
        [(1, 0, 0.5, 0.0), (1, 1, 0.5, 0.001), (1, 2, 0.9, 0.0)], "idx bigint, t bigint, x double, y double"
    ).withColumns({"angle": F.lit(0.0), "symmetry": F.lit(0.0)})
    targets = spark.createDataFrame([(1, 0, 0.5, 0.0), (1, 1, 0.6, 0.0)], "idx bigint, k int, x double, y double").withColumn("angle", F.lit(0.0))
    got = [(r["t"], r["k"], r["rank"]) for r in go.nearest_open_target(objects, targets).orderBy("rank").collect()]
    assert got == [(2, 1, 0), (1, 1, 1)]


def test_order_violation_spares_the_restoring_goal(spark):
    rows = [(1, 0, True), (1, 1, False), (1, 2, True), (1, 3, False), (2, 0, False), (2, 1, False), (2, 2, True), (3, 0, True), (3, 1, True)]
    goals = spark.createDataFrame(rows, "idx bigint, k int, done boolean")
    assert {r["idx"]: r["violated"] for r in go.order_violations(goals).collect()} == {1: True, 2: False, 3: False}


def test_packed_and_exploded_detections_agree(spark):
    frames = spark.createDataFrame([(1, [2, 2, 0, 3, 0, 0, 2, 0, 0]), (2, [5, 0, 0, 0, 0, 0, 0, 0, 5])], "frame bigint, ids array<int>")
    flat = frames.select("frame", F.posexplode("ids").alias("at", "id")).select(
        "frame", F.floor(F.col("at") / 3).alias("y"), (F.col("at") % 3).cast("bigint").alias("x"), "id"
    )
    packed = sorted(map(tuple, sc.detections_packed(frames, 3).collect()))
    assert packed == sorted(map(tuple, sc.detections(flat, ["frame"]).collect()))
    assert (1, 2, 0, 1, 2, 1) in packed and (2, 5, 1, 1, 2, 2) in packed


def test_area_crop_keeps_the_mean(spark):
    pixels = spark.range(36).select(
        F.lit(1).alias("frame"), F.floor(F.col("id") / 6).alias("y"), (F.col("id") % 6).alias("x"),
        F.lit(2).alias("id"), F.col("id").cast("double").alias("grey"),
    )
    crop = sc.area_crops(pixels, sc.boxes(pixels, ["frame"]), ["frame"], "grey", 4).collect()
    assert len(crop) == 16
    assert sum(r["grey"] for r in crop) / 16 == pytest.approx(sum(range(36)) / 36)


def test_fill_keeps_unknown_slots_and_lowers_the_rest(spark):
    values = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("X"))
    row = one(
        spark, p=X.fill(F.lit(" move  {a} {adv} to {Unknown} NOW"), values), q=X.fill(F.lit("done."), values)
    )
    assert row["p"] == "Move {b} to {unknown} now."
    assert row["q"] == "Done."


def test_slots_by_position(spark):
    row = one(
        spark,
        strict=X.extract_slots(F.lit("Put the {x} into {y}."), F.lit("{verb} {art} {obj} into {obj}.")),
        uneven=X.extract_slots(F.lit("Put the {x}"), F.lit("{verb} {art}")),
        cut=X.extract_slots(F.lit("Put the {x}:"), F.lit("{verb} {art}"), strict=False),
    )
    assert row["strict"] == {"verb": "put", "art": "the", "obj": "{y}"}
    assert row["uneven"] is None
    assert row["cut"] == {"verb": "put", "art": "the"}


def test_textures_are_masked_longest_first(spark):
    row = one(spark, m=pr.mask_textures(F.lit("the dark red box and the red box"), F.array(F.lit("red"), F.lit("dark red"))))
    assert row["m"]["text"] == "the {texture_0} box and the {texture_1} box"
    assert row["m"]["names"] == ["dark red", "red"]


PROMPTS = [
    (1, 0, "Put the {dragged_obj_1} into {base_obj_1}."),
    (2, 0, "Juggle the {dragged_obj_1} into {base_obj_1}."),
    (3, 16, "Put {dragged_obj_1} into {base_obj_1}. Finally restore it in its original container."),
    (4, 3, "Rearrange to this {scene}."),
]


def asked(spark):
    return spark.createDataFrame(PROMPTS, "idx bigint, task int, prompt string")


def test_nonsense_keeps_shape(spark):
    before = {r["idx"]: r["prompt"].split(" ") for r in asked(spark).collect()}
    for row in asked(spark).transform(pr.nonsense_words("s")).collect():
        old, new = before[row["idx"]], row["prompt"].split(" ")
        assert [w for w in old if w.startswith("{")] == [w for w in new if w.startswith("{")]
        assert [w.startswith("{") for w in old] == [w.startswith("{") for w in new]
        assert sorted(map(len, old)) == sorted(map(len, new))


def test_reworded_prompts_keep_their_assets(spark):
    sets = pr.template_sets(V.TEMPLATES, V.SLOTS)
    got = {r["idx"]: r for r in pr.reword(asked(spark), sets, "s").collect()}
    assert got[2]["status"] == "no template fits" and got[2]["prompt"] is None
    for idx in (1, 3):
        assert "{dragged_obj_1}" in got[idx]["prompt"] and "{base_obj_1}" in got[idx]["prompt"]
    assert "{scene}" in got[4]["prompt"]


def test_all_wordings_against_brute_force(spark):
    sets = pr.template_sets(V.TEMPLATES, V.SLOTS)
    rows = asked(spark).where("idx IN (1, 4)")
    most = pr.most_choices(V.TEMPLATES, V.SLOTS)
    got = {(r["task"], r["prompt"]) for r in pr.all_wordings(rows, sets, "s", most).collect()}
    want = set()
    for task, assets in (("visual_manipulation", {"dragged_obj": "{dragged_obj_1}", "base_obj": "{base_obj_1}"}), ("rearrange", {"scene": "{scene}"})):
        slots = V.SLOTS[task]
        for words in itertools.product(*slots.values()):
            for template in V.TEMPLATES[task]:
                text = template.format(**dict(zip(slots, words, strict=True)), **assets)
                want.add((dims.TASKS[task], (text.capitalize() + ".").replace("  ", " ")))
    assert got == want


def test_textual_prompts(spark):
    one_object = F.array(F.struct(F.lit("box").alias("name"), F.lit("red").alias("texture")))
    rows = asked(spark).withColumn(
        "assets", F.create_map(F.lit("dragged_obj_1"), one_object, F.lit("scene"), F.concat(one_object, one_object))
    )
    sets = pr.template_sets(V.TEXTUAL_TEMPLATES, V.SLOTS)
    got = {r["idx"]: r for r in rows.transform(pr.textual(sets, "s")).collect()}
    assert got[1]["prompt"] == "Put the red box into {base_obj_1}."
    assert got[3]["status"] == "ok" and "red box" in got[3]["prompt"] and got[3]["prompt"] != PROMPTS[2][2]
    assert got[4]["status"] == "avoided" and got[4]["prompt"] == PROMPTS[3][2]


def test_placeholder_tokens():
    tokens = pr.placeholder_tokens()
    assert "{base_obj}" in tokens and "{base_obj_10}" in tokens and "{ring_0}" not in tokens


def test_vocabulary_ids_are_dense(spark):
    tokens = spark.createDataFrame([(w,) for w in "a b a c d a".split()], "token string")
    vocabulary = sq.vocabulary(tokens).collect()
    assert sorted(r["token_id"] for r in vocabulary) == [0, 1, 2, 3]
    assert {r["token"]: r["n"] for r in vocabulary}["a"] == 3


def test_padding_reaches_the_longest_member(spark):
    rows = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 6), (0, 1, 0, 7), (1, 0, 0, 8)], "batch int, slot int, t int, v int")
    got = sorted(map(tuple, sq.pad_rows(rows, "batch", ["slot"], "t", {"v": F.lit(-100)}).collect()))
    assert got == [(0, 0, 0, 5), (0, 0, 1, 6), (0, 1, 0, 7), (0, 1, 1, -100), (1, 0, 0, 8)]


def test_run_names(spark):
    rows = spark.createDataFrame(
        [
            ("ftwoyjb1", ["TextualDescriptionTransform"], None, False, True, False, "distracting", "num_dragged_obj"),
            ("drmm3ugl", ["NoopTransform"], None, False, False, True, "easy", "20"),
            ("nobody", ["NoopTransform"], None, False, False, False, "easy", "20"),
        ],
        "model_id string, targets array<string>, method string, no_text boolean, no_visual boolean, shuffle_objects boolean, difficulty string, max_timesteps string",
    )
    got = {r["model_id"]: (r["run_name"], r["status"]) for r in ru.backfill(rows, ru.model_table(spark)).collect()}
    assert got["ftwoyjb1"] == ("X+ObjShuf / Orig - ObjText + No VisRef [Dstr] [ObjTime]", "ok")
    assert got["drmm3ugl"] == ("X+Obj / Origw/Null - ShufObj", "ok")
    assert got["nobody"] == (None, "unknown model")


# --- goals -----------------------------------------------------------------------------------------


def on_places(spark, places, name):
    """Objects or targets of episode 1 at the given x."""
    rows = [(1, i, float(x), 0.0, 0.0, 0.0) for i, x in places]
    return spark.createDataFrame(rows, f"idx bigint, {name} bigint, x double, y double, angle double, symmetry double")


def test_forbidden_pairs_and_two_objects_on_one_target(spark):
    objects = on_places(spark, [(0, 0.1), (1, 0.1), (2, 0.5)], "t")
    targets = on_places(spark, [(0, 0.1), (1, 0.5)], "k").drop("symmetry")
    allowed = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 0)], "idx bigint, t bigint, k bigint")

    def progress(**options):
        return go.pose_progress(objects, targets, **options).first()["progress"]

    assert progress() == pytest.approx(1)
    assert progress(allowed=allowed) == pytest.approx(2 / 3)  # object 2 stands on a forbidden target
    assert progress(exclusive=True) == pytest.approx(2 / 3)  # objects 0 and 1 share a target
    assert progress(allowed=allowed, exclusive=True) == pytest.approx(1 / 3)
    free = go.nearest_open_target(objects, targets, allowed.union(spark.createDataFrame([(1, 1, 1)], allowed.schema)))
    assert [tuple(r) for r in free.select("t", "k", "rank").collect()] == [(1, 1, 0)]


def test_assignment_in_order_equals_a_plain_loop(spark):
    import random

    draw = random.Random(4)
    pairs = {(draw.randrange(40), draw.randrange(8), draw.randrange(8)) for _ in range(2000)}
    want, used = set(), set()
    for idx, t, k in sorted(pairs):
        if (idx, "t", t) not in used and (idx, "k", k) not in used:
            used |= {(idx, "t", t), (idx, "k", k)}
            want.add((idx, t, k))
    frame = spark.createDataFrame(sorted(pairs, key=lambda _: draw.random()), "idx bigint, t bigint, k bigint")
    assert {tuple(r) for r in go.assign_in_order(frame.repartition(5)).collect()} == want


def test_goals_popped_in_order_over_slices(spark, monkeypatch):
    import random

    monkeypatch.setattr(go, "SLICE_STEPS", 16)
    draw = random.Random(5)
    rows = [(i, t, draw.choice("abcdx")) for i in range(30) for t in range(draw.choice([1, 5, 200]))]
    goals = [F.col("v").isin("a", "b"), F.col("v") == "b", F.col("v") == "c", F.col("v") == "d"]
    holds = ["ab", "b", "c", "d"]
    want = {}
    for idx in range(30):
        times, early = [], None
        for _, t, v in [r for r in rows if r[0] == idx]:
            k = len(times)
            if k < 4 and v in holds[k]:
                times.append(t)
            elif early is None and any(v in holds[j] for j in range(k + 1, 3)):
                early = t
        want[idx] = (times, len(times), early)
    frame = spark.createDataFrame(rows, "idx bigint, t bigint, v string").repartition(6)
    got = {r["idx"]: (r["times"], r["goals_done"], r["violated_at"]) for r in go.follow_goals(frame, goals).collect()}
    assert got == want


# --- transforms by name, metric state, nested values -------------------------------------------------


def test_configured_transforms_are_checked_before_a_job(spark):
    from episodium.operators import registry

    rows = spark.createDataFrame([(1, "Put {a} here")], "idx bigint, prompt string")
    chained = registry.apply(rows, [{"name": "noop"}, {"name": "nonsense_words", "seed": 3}])
    assert chained.first()["prompt"] == rows.transform(pr.nonsense_words(3)).first()["prompt"]
    for config, message in (
        ([{"name": "nothing"}], "not one of"),
        ([{"name": "nonsense_words"}], "seed"),
        ([{"name": "noop", "seed": 3}], "seed"),
        ([{"name": "noop"}, {"name": "reword", "seed": 3}], "no column task"),
    ):
        with pytest.raises(ValueError, match=message):
            registry.apply(rows, config)
    assert {"noop", "reword", "textual", "other_instruction"} <= set(registry.names())


def test_required_placeholders_may_come_from_the_assets(spark):
    rows = spark.createDataFrame([(i, 0, "Put the {dragged_obj_1} on the {base_obj_1}.") for i in range(20)], "idx bigint, task int, prompt string")
    sets = pr.template_sets(V.TEMPLATES, V.SLOTS)
    required = F.array(F.lit("dragged_obj_1"), F.lit("hidden_asset"))
    assert {r["status"] for r in pr.reword(rows, sets, 1).collect()} == {"ok"}
    assert {r["status"] for r in pr.reword(rows, sets, 1, required=required).collect()} == {"no valid wording"}


def test_metric_state_merges_replays_and_resets(spark, tmp_path):
    from episodium.operators import metric_state

    rows = [(p, t, s % 2 == 0, s) for p in (1, 2) for t in (0, 5) for s in range(7)]
    frame = spark.createDataFrame(rows, "partition int, task int, is_successful_at_end boolean, steps_taken bigint")
    state = metric_state.online_state(spark, str(tmp_path / "state"))
    assert state.merged() is None and metric_state.online_rows(state) is None
    for name in ("a", "b", "a"):
        state.update(frame.where(F.col("steps_taken") < 3 if name == "a" else F.col("steps_taken") >= 3), name)
    assert sorted(metric_state.online_rows(state).collect()) == sorted(ev.online_metrics(frame).collect())
    state.reset()
    assert state.merged() is None
    with pytest.raises(ValueError, match="name"):
        state.update(frame, "a/b")


def test_nested_collation_at_every_depth(spark):
    from episodium.functions import nested

    rows = [
        (0, {"a": [[1], [2, 3, 4]], "b": {"m": [True], "s": 5}}, [1.0]),
        (0, {"a": None, "b": {"m": None, "s": 6}}, [1.0, 2.0]),
        (0, {"a": [None, []], "b": None}, None),
        (1, {"a": [], "b": {"m": [], "s": 7}}, []),
    ]
    schema = "batch int, v struct<a:array<array<int>>,b:struct<m:array<boolean>,s:int>>, w array<double>"
    got = nested.collate(spark.createDataFrame(rows, schema), "batch", ["v", "w"], {"v.a": -100, "w": -1e9}).collect()
    found = sorted((r["batch"], r["v"]["a"], r["w"]) for r in got)
    pad = [-100] * 3
    assert found == sorted([
        (0, [[1, -100, -100], [2, 3, 4]], [1.0, -1e9]), (0, [pad, pad], [1.0, 2.0]), (0, [pad, pad], [-1e9, -1e9]), (1, [], []),
    ])
    assert sorted(str(r["v"]["b"]) for r in got) == sorted(
        ["Row(m=[True], s=5)", "Row(m=[False], s=6)", "None", "Row(m=[], s=7)"]
    )
    frame = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],)], "x array<array<int>>")
    kind = frame.schema["x"].dataType
    r = frame.select(
        nested.transpose(F.col("x"), kind).alias("t"), nested.cut(F.col("x"), kind, 1, 5).alias("c"),
        nested.concat(F.col("x"), F.col("x"), kind).alias("j"), nested.add_batch_dim(F.col("x"), kind).alias("b"),
    ).first()
    assert r["t"] == [[1, 4], [2, 5], [3, 6]] and r["c"] == [[4, 5, 6]] and len(r["j"]) == 4 and len(r["b"]) == 1
    with pytest.raises(ValueError, match="two axes"):
        nested.transpose(F.array(F.lit(1)), frame.select(F.array(F.lit(1)).alias("y")).schema["y"].dataType)
