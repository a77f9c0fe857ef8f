"""Fixed values of the data model: small dimension tables, bounds and labels.

Everything here is a published constant of the data model and therefore small by definition
(at most a few dozen rows); it is safe to broadcast or to inline as literals.
"""

from __future__ import annotations

import math

# --- fixed values: generalisation levels ---------------------------------------------------
PARTITIONS = {
    "training": 0,
    "placement_generalization": 1,
    "combinatorial_generalization": 2,
    "novel_object_generalization": 3,
    "novel_task_generalization": 4,
}

# --- fixed values: tasks and their old names ------------------------------------------------
TASKS = {
    "visual_manipulation": 0,
    "scene_understanding": 1,
    "rotate": 2,
    "rearrange": 3,
    "rearrange_then_restore": 4,
    "novel_adj": 5,
    "novel_noun": 6,
    "novel_adj_and_noun": 7,
    "twist": 8,
    "follow_motion": 9,
    "follow_order": 10,
    "sweep_without_exceeding": 11,
    "sweep_without_touching": 12,
    "same_texture": 13,
    "same_shape": 14,
    "manipulate_old_neighbor": 15,
    "pick_in_order_then_restore": 16,
}
TASK_ALIASES = {"same_color": 13, "same_profile": 14, "sweep": 11, "simple_manipulation": 0}
TASK_IDS_BY_ANY_NAME = {**TASKS, **TASK_ALIASES}

# --- fixed values: task groups ----------------------------------------------------------------
TASK_GROUPS = {
    "instruction_following": 1,
    "constraint_satisfaction": 2,
    "novel_concept_grounding": 3,
    "one_shot_imitation": 4,
    "rearrangement": 5,
    "require_memory": 6,
    "require_reasoning": 7,
}
GROUP_OF_TASK = {
    0: 1, 1: 1, 2: 1,
    11: 2, 12: 2,
    5: 3, 6: 3, 7: 3, 8: 3,
    9: 4, 10: 4,
    3: 5,
    4: 6, 15: 6, 16: 6,
    13: 7, 14: 7,
}

# --- fixed values: tasks whose visual references cannot be put into words ---------------------
TASKS_KEPT_VISUAL = [
    "novel_adj",
    "follow_order",
    "follow_motion",
    "twist",
    "rearrange",
    "rearrange_then_restore",
    "novel_adj_and_noun",
    "scene_understanding",
]

# --- fixed values: which tasks are evaluated at which level ------------------------------------
_LEVEL_1 = [0, 1, 2, 3, 4, 5, 6, 8, 10, 11, 14, 15, 16]
TASKS_PER_LEVEL = {
    1: _LEVEL_1,
    2: _LEVEL_1,
    3: [task for task in _LEVEL_1 if task != 11],
    4: [7, 9, 12, 13],
}

# --- fixed values: published success rates of the earlier model, 100 episodes per task ----------
PUBLISHED_SEEN = 100
PUBLISHED_SUCCESS = {
    1: {0: 1.0, 1: 1.0, 2: 0.995, 3: 1.0, 4: 0.565, 5: 1.0, 6: 1.0, 8: 0.18, 10: 0.77, 11: 0.93,
        14: 0.97, 15: 0.765, 16: 0.43},
    2: {0: 1.0, 1: 1.0, 2: 0.995, 3: 1.0, 4: 0.545, 5: 1.0, 6: 1.0, 8: 0.175, 10: 0.77, 11: 0.93,
        14: 0.985, 15: 0.75, 16: 0.45},
    3: {0: 0.99, 1: 1.0, 2: 1.0, 3: 0.97, 4: 0.545, 5: 1.0, 6: 0.99, 8: 0.175, 10: 0.77,
        14: 0.975, 15: 0.46, 16: 0.435},
    4: {7: 1.0, 9: 0.0, 12: 0.0, 13: 0.945},
}

# --- fixed values: action axes --------------------------------------------------------------
# axis -> (minimum, maximum, number of bins)
AXIS_SPEC = {
    "x": (0.25, 0.75, 50),
    "y": (-0.5, 0.5, 100),
    "z": (0.0, 0.32, 50),
    "rot": (-1.0, 1.0, 50),
}
POSE_AXES = {
    "pose0_position": ["x", "y", "z"],
    "pose0_rotation": ["x", "y", "z", "w"],
    "pose1_position": ["x", "y", "z"],
    "pose1_rotation": ["x", "y", "z", "w"],
}
IGNORED_TARGET = -100
MASKED_LOGIT = -1e9
START_POSITION = (0.5, 0.0, 0.32)
START_POSITION_2D = (0.5, 0.0)
START_ROTATION = (0.0, 0.0, 0.0, 1.0)
BACKGROUND_IDS = (0, 1)
END_EFFECTORS = {"suction": 0, "spatula": 1}

# --- fixed values: workspace and matching tolerances --------------------------------------------
WORKSPACE_X = (0.25, 0.75)
WORKSPACE_Y = (-0.5, 0.5)
POSITION_TOLERANCE = 0.01
ROTATION_TOLERANCE = math.radians(15.0)
OVERLAP_MARGIN = 0.01
PROGRESS_TOLERANCE = 0.001
ORACLE_BONUS_STEPS = 2
DARKEN_BY = 0.3

# --- fixed values: split and shard settings ---------------------------------------------------
VALIDATION_INSTANCES = 50_000
SHARDS_PER_SPLIT = {"train": 20, "valid": 5}
SEED_SPACING = 999

# --- fixed values: prompt asset names and how often each is numbered (None: not numbered) ---------
ASSET_PLACEHOLDERS = {
    "base_obj": 10,
    "dragged_obj": 10,
    "swept_obj": None,
    "bounds": None,
    "constraint": None,
    "scene": None,
    "demo_blicker_obj": 10,
    "demo_less_blicker_obj": 10,
    "start_scene": 10,
    "end_scene": 10,
    "before_twist": 10,
    "after_twist": 10,
    "frame": 10,
    "ring": None,
    "hanoi_stand": None,
}

# --- fixed values: 20-colour categorical palette for segmentation ids ------------------------------
SEGMENT_PALETTE = [
    (31, 119, 180), (174, 199, 232), (255, 127, 14), (255, 187, 120), (44, 160, 44),
    (152, 223, 138), (214, 39, 40), (255, 152, 150), (148, 103, 189), (197, 176, 213),
    (140, 86, 75), (196, 156, 148), (227, 119, 194), (247, 182, 210), (127, 127, 127),
    (199, 199, 199), (188, 189, 34), (219, 219, 141), (23, 190, 207), (158, 218, 229),
]

# --- fixed values: baseline runs by display name ------------------------------------------------
BASELINE_RUNS = {
    "X+Obj / Orig": "sm0t3gea",
    "X+Ptch / Orig": "q95fzf7i",
    "D+Obj / Orig": "l2whu45i",
    "D+Ptch / Orig": "x9k1z1hu",
    "X+Obj / Para": "wsqkbn9g",
    "X+Ptch / Para": "4x7w18dx",
    "D+Obj / Para": "1thybzlh",
    "D+Ptch / Para": "bkrjv2wv",
}

# --- fixed values: properties of the trained models -----------------------------------------------
TRAINED_INSTRUCTION = {
    "Given": "original",
    "8lkml12g": "original",
    "2df3mwfn": "paraphrases",
    "0nsnkaer": "paraphrases",
    "ftwoyjb1": "original",
    "wa2rtion": "original",
    "b2slg2rh": "paraphrases",
    "drmm3ugl": "original",
    "bhuja4vo": "original",
    "wn9jc5l8": "original",
    "efxugme9": "original",
    "ln4nrqhg": "original",
    "53afo878": "original",
    "xivdgqm0": "original",
    "uuee5jre": "original",
    "6fmcpjg4": "original",
    "zby6xk27": "paraphrases",
    "fs5v61mz": "paraphrases",
    "ah5btw8w": "paraphrases",
    "xb3yttg9": "paraphrases",
    "bpmv9tbi": "none",
    "ib93h28o": "none",
    "949w4zfi": "none",
    "lcz1hs8a": "none",
}
DECODER_ONLY = [
    "bhuja4vo", "wn9jc5l8", "53afo878", "efxugme9", "fs5v61mz", "zby6xk27", "949w4zfi",
    "lcz1hs8a", "xb3yttg9",
]
PATCH_ENCODER = [
    "efxugme9", "ln4nrqhg", "53afo878", "xivdgqm0", "uuee5jre", "zby6xk27", "ah5btw8w",
    "ib93h28o", "lcz1hs8a",
]
SHUFFLED_OBJECTS = ["ftwoyjb1", "0nsnkaer", "wn9jc5l8", "xb3yttg9"]
WITHOUT_TEXT = ["uuee5jre", "6fmcpjg4", "bpmv9tbi", "ib93h28o", "949w4zfi", "lcz1hs8a"]
WITHOUT_VISUAL_REFERENT = ["bpmv9tbi", "ib93h28o", "949w4zfi", "lcz1hs8a"]
FOURTEEN_TOKENS = ["wa2rtion", "b2slg2rh", "53afo878", "xivdgqm0"]
WITH_NULL_ACTION = ["drmm3ugl"]

# --- fixed values: words used in run display names -------------------------------------------------
CONDITIONING_LETTER = {"dec_only": "D", "xattn": "X"}
ENCODER_WORD = {"obj_centric": "Obj", "patches": "Ptch"}
TRANSFORM_WORDS = {
    "textual": "ObjText",
    "gobbledygook_word": "GDGWord",
    "gobbledygook_tokens": "GDGToken",
    "reworded": "Para",
    "textual_gobbledygook_word": "ObjText + GDGWord",
    "textual_gobbledygook_tokens": "ObjText + GDGToken",
    "noop": "",
    "diff_instruction": "DiffInstr",
}
DESCRIPTION_WORDS = {
    "underspecify_nouns": "GenericNoun",
    "remove_textures": "NoTexture",
    "remove_nouns": "NoNoun",
}
MODALITY_WORDS = {
    "disable_both": "No Prompt",
    "disable_text": "No Text",
    "disable_visual": "No VisRef",
    "disable_none": "",
}
DIFFICULTY_WORDS = {
    "easy": "",
    "medium": "Med",
    "hard": "Hard",
    "distracting": "Dstr",
    "extreme": "Xtr",
    "extremely_distracting": "XD",
}
TIME_LIMIT_WORDS = {"oracle_max_steps": "OracleTime", "num_dragged_obj": "ObjTime"}
MODEL_TITLE = {"xattn": "Cross-Attn", "dec_only": "Concatenate"}
ENCODER_TITLE = {"obj_centric": "Obj-Centric", "patches": "Patches"}
MISSING_CELL = "{---}"
