"""Instruction templates and slot vocabularies, as data.

A template is plain text with ``{slot}`` marks.  ``SLOTS[task][slot]`` lists the words a slot may
take; a slot that is not listed stands for a prompt asset and is carried over unchanged.
"""

from __future__ import annotations


# --- fixed values: slot vocabularies ------------------------------------------------------------
ANGLE_UNITS = ["degrees"]
LIFTING_VERBS = ["pick up", "take", "lift", "grab"]
PLACING_VERBS = ["put", "place", "move", "position", "drop", "store", "stick", "set"]
MOVING_VERBS = ["move", "relocate", "shift", "place"]
SWEEP_VERBS = ["put", "place", "position", "sweep", "push", "shove", "move", "relocate", "shift"]
STACK_VERBS = ["stack", "place", "put", "rearrange"]
ROTATING_VERBS = ["rotate", "turn", "spin", "pivot", "swivel"]
REARRANGE_VERBS = ["rearrange", "reposition", "reorder", "reorganize"]
HOLDING_VERBS = ["hold", "contain", "have"]
DOING_VERB = ["make"]
FOLLOW_VERBS = ["follow", "copy", "imitate"]
MOVED_VERBS = ["moved", "relocated", "shifted", "placed"]
ROTATING_WORDS = ["rotating", "turning", "spinning", "placing", "moving", "positioning"]
OPENING_WORDS = ["first", "start by", "begin by", "initially"]
ARTICLE = ["the", "one"]
QUANTITY_ARTICLE = ["the", "of the"]
QUANTITIES = ["all", "all the", "the"]
PREPOSITIONS = ["onto", "into", "on top of", "within the confines of", "on"]
ASSOCIATION_PREPOSITIONS = ["with"]
CONTAIN_PREPOSITIONS = ["in", "inside", "within", "inside of", "into"]
REARRANGE_PREPOSITIONS = ["into", "to"]
SINGULAR_NOUNS = ["object", "item", "thing"]
PLURAL_NOUNS = ["objects", "items", "things"]
LOCATIONS = ["place", "location", "spot", "position", "area", "zone"]
PRECISION_ADVERBS = ["exactly", "precisely", "about", "around", "approximately", "roughly"]
ORDER_WORDS = ["order", "way", "manner", "sequence"]
SCENE_WORDS = ["scene", "arrangement", "configuration", "layout", "setup", "composition"]
RESTORE_WORDS = ["restore", "put it back", "undo", "reverse", "revert back"]
EXCEEDING_WORDS = [
    "exceeding", "going over", "surpassing", "overstepping", "going beyond", "fully crossing",
]
TOUCHING_WORDS = ["touching", "reaching"]
CONTAINER_NOUNS = ["container", *SINGULAR_NOUNS, *LOCATIONS]
SAME_WORDS = ["same", "identical", "matching", "similar"]
TEXTURE_WORDS = ["texture", "pattern", "look", "style"]
PROFILE_WORDS = ["profile", "shape", "form", "structure"]
STARTING_WORDS = ["starting", "original", "initial"]
FINALLY_WORDS = ["finally", "last", "then"]
MOTION_WORDS = ["motion", "movement", "maneuver"]
BUILD_WORDS = ["build", "create", "construct", "form", "make"]

# --- fixed values: rewording templates per task ---------------------------------------------------
TEMPLATES: dict[str, list[str]] = {
    "visual_manipulation": [
        "{placing_verb} {article1} {dragged_obj} {preposition} {base_obj}",
        "{placing_verb} {dragged_obj} {preposition} {base_obj}",
        "{placing_verb} {dragged_obj} {preposition} {article1} {base_obj}",
        "{placing_verb} {article1} {dragged_obj} {preposition} {article2} {base_obj}",
        "{lifting_verb} {dragged_obj} and {placing_verb} {preposition} {base_obj}",
    ],
    "scene_understanding": [
        "{placing_verb} {article1} {dragged_texture} {singular_noun1} in {scene} {preposition} {article2} {base_texture} {singular_noun2}",
        "From the {scene} {placing_verb} {article1} {dragged_texture} {singular_noun1} {preposition} {article2} {base_texture} {singular_noun2}",
        "{placing_verb} {article1} {dragged_texture} {singular_noun1} {preposition} {article2} {base_texture} {singular_noun2} in the {scene}",
        "{doing_verb} {article2} {base_texture} {singular_noun1} {holding_verb} {article1} {dragged_texture} {singular_noun2} in {scene}",
        "{moving_verb} {plural_noun1} in the {scene} so that {article1} {dragged_texture} {singular_noun2} are {preposition} {article2} {base_texture} {singular_noun2}",
    ],
    "rotate": [
        "{rotate_verb} {article1} {dragged_obj} {angle_in_degree} {angle_unit}",
        "{precision_adverb1} {rotate_verb} {article1} {dragged_obj} {angle_in_degree} {angle_unit}",
        "{rotate_verb} {article1} {dragged_obj} {precision_adverb1} {angle_in_degree} {angle_unit}",
        "{pickup_verb} {article1} {dragged_obj} and {rotate_verb} {angle_in_degree} {angle_unit}",
        "{pickup_verb} {article1} {dragged_obj} and {rotate_verb} it {angle_in_degree} {angle_unit}",
    ],
    "rearrange": [
        "{rearrange_verb} {preposition} this {scene}",
        "{rearrange_verb} {plural_noun} {preposition} this {scene_word} {scene}",
    ],
    "rearrange_then_restore": [
        "{rearrange_verb} {preposition} this {scene} and then {restore_word}",
        "{rearrange_verb} {preposition} this {scene} and {restore_word}",
        "{rearrange_verb} {plural_noun} {preposition} this {scene_word} {scene} and then {restore_word}",
        "{rearrange_verb} {plural_noun} {preposition} this {scene_word} {scene} and {restore_word}",
    ],
    "novel_adj": [
        "{demo_blicker_obj_1} is {novel_adj} than {demo_blicker_obj_2}. {demo_blicker_obj_3} is {novel_adj} than {demo_blicker_obj_4}. {demo_blicker_obj_5} is {novel_adj} than {demo_blicker_obj_6}. {placing_verb} the {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}.",
        "{demo_blicker_obj_1} is {novel_adj} than {demo_blicker_obj_2}. {demo_blicker_obj_3} is {novel_adj} than {demo_blicker_obj_4}. {placing_verb} the {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}.",
        "{demo_blicker_obj_1} is {novel_adj} than {demo_blicker_obj_2}. {placing_verb} the {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}.",
        "{object1} {object3} and {object5} are all {novel_adj} than {plural_noun} {object2} {object4} and {object6} respectively. {placing_verb} the {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}",
        "{object1} and {object3} are both {novel_adj} than {plural_noun} {object2} and {object4} respectively. {placing_verb} the {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}",
        "{demo_blicker_obj_1} is {novel_adj} than {demo_blicker_obj_2}. {demo_blicker_obj_3} is {novel_adj} than {demo_blicker_obj_4}. {demo_blicker_obj_5} is {novel_adj} than {demo_blicker_obj_6}. {placing_verb} the {adv} {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}.",
        "{demo_blicker_obj_1} is {novel_adj} than {demo_blicker_obj_2}. {demo_blicker_obj_3} is {novel_adj} than {demo_blicker_obj_4}. {placing_verb} the {adv} {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}.",
        "{demo_blicker_obj_1} is {novel_adj} than {demo_blicker_obj_2}. {placing_verb} the {adv} {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}.",
        "{object1} {object3} and {object5} are all {novel_adj} than {plural_noun} {object2} {object4} and {object6} respectively. {placing_verb} the {adv} {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}",
        "{object1} and {object3} are both {novel_adj} than {plural_noun} {object2} and {object4} respectively. {placing_verb} the {adv} {novel_adj} {dragged_obj} {contain_preposition} the {base_obj}",
    ],
    "novel_noun": [
        "This is a {novel_noun1} {object1}. This is a {novel_noun2} {object2}. {placing_verb} the {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "This is a {novel_noun1} {object1} and this is a {novel_noun2} {object2}. {placing_verb} the {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "This is a {novel_noun2} {object2}. This is a {novel_noun1} {object1}. {placing_verb} the {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "This is a {novel_noun2} {object2} and this is a {novel_noun1} {object1}. {placing_verb} the {novel_noun1} {contain_preposition} the {novel_noun2}.",
    ],
    "follow_motion": [
        "{moving_verb} the {object1} like this: {frame1}",
        "{moving_verb} the {object1} like this: {frame1} {frame2}",
        "{moving_verb} the {object1} like this: {frame1} {frame2} {frame3}",
        "{moving_verb} the {object1} in this {way_word}: {frame1}",
        "{moving_verb} the {object1} in this {way_word}: {frame1} {frame2}",
        "{moving_verb} the {object1} in this {way_word}: {frame1} {frame2} {frame3}",
        "{follow_verb} this {motion_word} for {object1}: {frame1}",
        "{follow_verb} this {motion_word} for {object1}: {frame1} {frame2}",
        "{follow_verb} this {motion_word} for {object1}: {frame1} {frame2} {frame3}",
    ],
    "follow_order": [
        "{stack_verb} {plural_noun} in this {order_word}: {frame1}",
        "{stack_verb} {plural_noun} in this {order_word}: {frame1} {frame2}",
        "{stack_verb} {plural_noun} in this {order_word}: {frame1} {frame2} {frame3}",
        "{build_noun} a {stack_noun} of {plural_noun} in this {order_word}: {frame1}",
        "{build_noun} a {stack_noun} of {plural_noun} in this {order_word}: {frame1} {frame2}",
        "{build_noun} a {stack_noun} of {plural_noun} in this {order_word}: {frame1} {frame2} {frame3}",
        "Follow this sequence to {build_noun} a {stack_noun} of {plural_noun}: {frame1}",
        "Follow this sequence to {build_noun} a {stack_noun} of {plural_noun}: {frame1} {frame2}",
        "Follow this sequence to {build_noun} a {stack_noun} of {plural_noun}: {frame1} {frame2} {frame3}",
        "Follow this sequence to {stack_verb} {plural_noun}: {frame1}",
        "Follow this sequence to {stack_verb} {plural_noun}: {frame1} {frame2}",
        "Follow this sequence to {stack_verb} {plural_noun}: {frame1} {frame2} {frame3}",
    ],
    "sweep_without_exceeding": [
        "{sweep_verb} {quantity} {object1} {preposition} {bounds} without {exceeding_constraint} {constraint}",
        "{sweep_verb} {quantity} {object1} {preposition} the {bounds} without {exceeding_constraint} the {constraint}",
    ],
    "sweep_without_touching": [
        "{sweep_verb} {quantity} {object1} {preposition} {bounds} without {touching_constraint} {constraint}",
        "{sweep_verb} {quantity} {object1} {preposition} the {bounds} without {touching_constraint} the {constraint}",
        "without {touching_constraint} the {constraint}, {sweep_verb} {quantity} {object1} {preposition} the {bounds}",
    ],
    "same_texture": [
        "{placing_verb} {quantity} {plural_noun} {association_preposition} {article1} {same} {texture} as {object1} {contain_preposition} it",
        "{placing_verb} {quantity} {article2} {plural_noun} {association_preposition} {article1} {same} {texture} as {object1} {contain_preposition} it",
    ],
    "same_shape": [
        "{placing_verb} {quantity} {plural_noun} {association_preposition} {article1} {same} {profile} as {object1} {contain_preposition} it",
        "{placing_verb} {quantity} {article2} {plural_noun} {association_preposition} {article1} {same} {profile} as {object1} {contain_preposition} it",
    ],
    "manipulate_old_neighbor": [
        "{preceeding_adjective} {placing_verb} {object1} {contain_preposition} {object2} then {placing_verb2} {article1} {singular_noun} that was previously at its {direction} into the same {object2}",
        "{placing_verb} {object1} {contain_preposition} {object2} then {placing_verb2} {article1} {singular_noun} that was at its {direction} {contain_preposition2} the same {object2}",
        "{placing_verb} {object1} {contain_preposition} {object2} then {placing_verb2} {article1} {singular_noun} that was at its {direction} {contain_preposition2} {object2}",
        "{placing_verb} {object1} {contain_preposition} {object2} then {placing_verb2} {article1} {singular_noun} that was at its {direction} before you {moved_verb} it into the same {object2}",
        "{placing_verb} {object1} {contain_preposition} {object2} then {placing_verb2} {article1} {singular_noun} that was at its {direction} before you {moved_verb} it into the same as {object1}",
        "{placing_verb} {object1} {contain_preposition} {object2} then {placing_verb2} {article1} {singular_noun} that was at its {direction} before you {moved_verb} it into the same {container_noun}",
        "{placing_verb} {object1} and {article1} {singular_noun} at its {direction} {contain_preposition} {object2} starting with {object1}",
        "{placing_verb} {object1} and {article1} {singular_noun} at its {direction} {contain_preposition} {object2} with {object1} first",
        "{placing_verb} {object1} and {article1} {singular_noun} at its {direction} {contain_preposition} {object2} with {object1} at the bottom",
    ],
    "pick_in_order_then_restore": [
        "{placing_verb} {object1} {contain_preposition} {object2}. {finally_alternative} {restore_word} it {contain_preposition2} {article1} {starting_alternative} {container_noun}",
        "{placing_verb} {object1} {contain_preposition} {object2} then {object3}. {finally_alternative} {restore_word} it {contain_preposition2} {article1} {starting_alternative} {container_noun}",
        "{placing_verb} {object1} {contain_preposition} {object2} and then {restore_word}",
        "{placing_verb} {object1} {contain_preposition} {object2} and {object3} and then {restore_word}",
    ],
    "novel_adj_and_noun": [
        "{this} is a {novel_noun1} {object1}. {this} is a {novel_noun2} {object2}. {object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {object7} is {novel_adj} than {object8}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun1} {object1}. {this} is a {novel_noun2} {object2}. {object3} {object5} and {object7} are all {novel_adj} than {plural_noun} {object4} {object6} and {object8} respectively. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {object7} is {novel_adj} than {object8}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {object7} is {novel_adj} than {object8}. {this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{object3} {object5} and {object7} are all {novel_adj} than {plural_noun} {object4} {object6} and {object8} respectively. {this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun1} {object1}. {this} is a {novel_noun2} {object2}. {object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun1} {object1}. {this} is a {novel_noun2} {object2}. {object3} is {novel_adj} than {object4}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {object3} is {novel_adj} than {object4}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{object3} is {novel_adj} than {object4}. {this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {placing_verb} the {adv} {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun1} {object1}. {this} is a {novel_noun2} {object2}. {object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {object7} is {novel_adj} than {object8}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun1} {object1}. {this} is a {novel_noun2} {object2}. {object3} {object5} and {object7} are all {novel_adj} than {plural_noun} {object4} {object6} and {object8} respectively. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {object7} is {novel_adj} than {object8}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {object7} is {novel_adj} than {object8}. {this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{object3} {object5} and {object7} are all {novel_adj} than {plural_noun} {object4} {object6} and {object8} respectively. {this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun1} {object1}. {this} is a {novel_noun2} {object2}. {object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{object3} is {novel_adj} than {object4}. {object5} is {novel_adj} than {object6}. {this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun1} {object1}. {this} is a {novel_noun2} {object2}. {object3} is {novel_adj} than {object4}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {object3} is {novel_adj} than {object4}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
        "{object3} is {novel_adj} than {object4}. {this} is a {novel_noun2} {object2}. {this} is a {novel_noun1} {object1}. {placing_verb} the {novel_adj} {novel_noun1} {contain_preposition} the {novel_noun2}.",
    ],
    "twist": [
        '"Twist" is defined as {rotating_word} some {singular_noun} a specific {angle_word}. For examples: From {before_twist1} to {after_twist1}. From {before_twist2} to {after_twist2}. Now twist all {texture} objects.',
        '"Twist" is defined as {rotating_word} some {singular_noun} a specific {angle_word}. For examples: From {before_twist1} to {after_twist1}. From {before_twist2} to {after_twist2}. From {before_twist3} to {after_twist3}. Now twist all {texture} objects.',
        '"Twist" is defined as {rotating_word} some {singular_noun} a specific {angle_word}. For examples: From {before_twist1} to {after_twist1}. Now twist all {texture} objects.',
        '"Twist" is defined as {rotating_word} {singular_noun} a specific {angle_word}. For examples: From {before_twist1} to {after_twist1}. From {before_twist2} to {after_twist2}. Now twist all {texture} objects.',
        '"Twist" is defined as {rotating_word} {singular_noun} a specific {angle_word}. For examples: From {before_twist1} to {after_twist1}. From {before_twist2} to {after_twist2}. From {before_twist3} to {after_twist3}. Now twist all {texture} objects.',
        '"Twist" is defined as {rotating_word} {singular_noun} a specific {angle_word}. For examples: From {before_twist1} to {after_twist1}. Now twist all {texture} objects.',
        '"Twist" is defined as {rotating_word} {plural_noun} a specific {angle_word}. For examples: From {before_twist1} to {after_twist1}. From {before_twist2} to {after_twist2}. Now twist all {texture} objects.',
        '"Twist" is defined as {rotating_word} {plural_noun} a specific {angle_word}. For examples: From {before_twist1} to {after_twist1}. From {before_twist2} to {after_twist2}. From {before_twist3} to {after_twist3}. Now twist all {texture} objects.',
        '"Twist" is defined as {rotating_word} {plural_noun} a specific {angle_word}. For examples: From {before_twist1} to {after_twist1}. Now twist all {texture} objects.',
    ],
}

_NOVEL_SLOTS = {
    "rearrange_verb": REARRANGE_VERBS,
    "preposition": REARRANGE_PREPOSITIONS,
    "plural_noun": PLURAL_NOUNS,
    "scene_word": SCENE_WORDS,
    "restore_word": RESTORE_WORDS,
    "placing_verb": PLACING_VERBS,
    "contain_preposition": CONTAIN_PREPOSITIONS,
}
_SAME_SLOTS = {
    "placing_verb": PLACING_VERBS,
    "quantity": QUANTITIES,
    "plural_noun": PLURAL_NOUNS,
    "association_preposition": ASSOCIATION_PREPOSITIONS,
    "contain_preposition": CONTAIN_PREPOSITIONS,
    "article1": ["the"],
    "article2": QUANTITY_ARTICLE,
    "same": SAME_WORDS,
}
_REARRANGE_SLOTS = {
    "rearrange_verb": REARRANGE_VERBS,
    "preposition": REARRANGE_PREPOSITIONS,
    "plural_noun": PLURAL_NOUNS,
    "scene_word": SCENE_WORDS,
}

# --- fixed values: which vocabulary a slot draws from, per task -------------------------------------
SLOTS: dict[str, dict[str, list[str]]] = {
    "visual_manipulation": {
        "lifting_verb": LIFTING_VERBS,
        "placing_verb": PLACING_VERBS,
        "article1": ARTICLE,
        "article2": ARTICLE,
        "preposition": PREPOSITIONS,
    },
    "scene_understanding": {
        "placing_verb": PLACING_VERBS,
        "article1": ARTICLE,
        "article2": ARTICLE,
        "preposition": PREPOSITIONS,
        "singular_noun1": SINGULAR_NOUNS,
        "singular_noun2": SINGULAR_NOUNS,
        "plural_noun1": PLURAL_NOUNS,
        "doing_verb": DOING_VERB,
        "holding_verb": HOLDING_VERBS,
        "moving_verb": MOVING_VERBS,
    },
    "rotate": {
        "pickup_verb": LIFTING_VERBS,
        "rotate_verb": ROTATING_VERBS,
        "article1": ARTICLE,
        "precision_adverb1": PRECISION_ADVERBS,
        "angle_unit": ANGLE_UNITS,
    },
    "rearrange": _REARRANGE_SLOTS,
    "rearrange_then_restore": {**_REARRANGE_SLOTS, "restore_word": RESTORE_WORDS},
    "novel_adj": _NOVEL_SLOTS,
    "novel_noun": _NOVEL_SLOTS,
    "novel_adj_and_noun": {**_NOVEL_SLOTS, "this": ["this"]},
    "twist": {
        "rotating_word": ROTATING_WORDS,
        "plural_noun": PLURAL_NOUNS,
        "singular_noun": SINGULAR_NOUNS,
        "angle_word": ["angle", "way", "amount"],
    },
    "follow_motion": {
        "moving_verb": MOVING_VERBS,
        "follow_verb": FOLLOW_VERBS,
        "motion_word": MOTION_WORDS,
        "way_word": ORDER_WORDS,
    },
    "follow_order": {
        "stack_verb": [*STACK_VERBS, "organize"],
        "stack_noun": ["stack", "pile", "tower", "structure"],
        "order_word": ORDER_WORDS,
        "plural_noun": PLURAL_NOUNS,
        "build_noun": BUILD_WORDS,
    },
    "sweep_without_exceeding": {
        "sweep_verb": SWEEP_VERBS,
        "preposition": CONTAIN_PREPOSITIONS,
        "exceeding_constraint": EXCEEDING_WORDS,
    },
    "sweep_without_touching": {
        "sweep_verb": SWEEP_VERBS,
        "preposition": CONTAIN_PREPOSITIONS,
        "touching_constraint": TOUCHING_WORDS,
    },
    "same_texture": {**_SAME_SLOTS, "texture": TEXTURE_WORDS},
    "same_shape": {**_SAME_SLOTS, "profile": PROFILE_WORDS},
    "manipulate_old_neighbor": {
        "placing_verb": PLACING_VERBS,
        "placing_verb2": PLACING_VERBS,
        "preceeding_adjective": OPENING_WORDS,
        "contain_preposition": CONTAIN_PREPOSITIONS,
        "contain_preposition2": CONTAIN_PREPOSITIONS,
        "article1": ["the"],
        "singular_noun": SINGULAR_NOUNS,
        "container_noun": CONTAINER_NOUNS,
        "moved_verb": MOVED_VERBS,
    },
    "pick_in_order_then_restore": {
        "article1": ["the", "its"],
        "placing_verb": PLACING_VERBS,
        "contain_preposition": CONTAIN_PREPOSITIONS,
        "contain_preposition2": CONTAIN_PREPOSITIONS,
        "finally_alternative": FINALLY_WORDS,
        "restore_word": RESTORE_WORDS,
        "starting_alternative": STARTING_WORDS,
        "container_noun": CONTAINER_NOUNS,
    },
}

# --- fixed values: word-order templates used when placeholders become text -----------------------
TEXTUAL_TEMPLATES: dict[str, list[str]] = {
    "pick_in_order_then_restore": [
        "{placing_verb} {object1} {contain_preposition} {container1}. {finally_alternative} {restore_word} it {contain_preposition2} {article1} {starting_alternative} {container_noun}",
        "{placing_verb} {object1} {contain_preposition} {container1} then {container2}. {finally_alternative} {restore_word} it {contain_preposition2} {article1} {starting_alternative} {container_noun}",
        "{placing_verb} the {object1} {contain_preposition} the {container1}. {finally_alternative} {restore_word} it {contain_preposition2} {article1} {starting_alternative} {container_noun}",
        "{placing_verb} the {object1} {contain_preposition} the {container1} and then the {container2}. {finally_alternative} {restore_word} it {contain_preposition2} {article1} {starting_alternative} {container_noun}",
    ],
    "novel_noun": [
        "This is a {novel_noun1} {object1}. This is a {novel_noun2} {object2}. {placing_verb} a {novel_noun1} {contain_preposition} a {novel_noun2}.",
        "A {novel_noun1} is a {object1}. A {novel_noun2} is a {object2}. {placing_verb} a {novel_noun1} {contain_preposition} a {novel_noun2}.",
        "A {novel_noun1} is a {object1}. A {novel_noun2} is a {object2}. {placing_verb} the {novel_noun1} {contain_preposition} the {novel_noun2}.",
    ],
    "sweep_without_exceeding": [
        "{sweep_verb} {quantity} {object1} {preposition} {bounds} without {exceeding_constraint} {constraint}",
        "{sweep_verb} {quantity} {object1} {preposition} the {bounds} without {exceeding_constraint} the {constraint}",
    ],
    "sweep_without_touching": [
        "{sweep_verb} {quantity} {object1} {preposition} {bounds} without {touching_constraint} {constraint}",
        "{sweep_verb} {quantity} {object1} {preposition} the {bounds} without {touching_constraint} the {constraint}",
    ],
    "manipulate_old_neighbor": [
        "{preceeding_adjective} {placing_verb} {object1} {contain_preposition} {object2} then {placing_verb2} {article1} {singular_noun} that was previously at its {direction} into the same {object2}",
        "{preceeding_adjective} {placing_verb} the {object1} {contain_preposition} the {object2} and then {placing_verb2} {article1} {singular_noun} that was previously at its {direction} into the same {object2}",
    ],
    "same_shape": [
        "{placing_verb} {quantity} {plural_noun} {association_preposition} {article1} {same} {profile} as {object1} {contain_preposition} it",
        "{placing_verb} {quantity} {article2} {plural_noun} {association_preposition} {article1} {same} {profile} as {object1} {contain_preposition} it",
        "{placing_verb} {quantity} {plural_noun} {association_preposition} {article1} {same} {profile} as the {object1} {contain_preposition} it",
        "{placing_verb} {quantity} {article2} {plural_noun} {association_preposition} {article1} {same} {profile} as the {object1} {contain_preposition} it",
    ],
    "same_texture": [
        "{placing_verb} {quantity} {plural_noun} {association_preposition} {article1} {same} {texture} as {object1} {contain_preposition} it",
        "{placing_verb} {quantity} {article2} {plural_noun} {association_preposition} {article1} {same} {texture} as {object1} {contain_preposition} it",
        "{placing_verb} {quantity} {plural_noun} {association_preposition} {article1} {same} {texture} as the {object1} {contain_preposition} it",
        "{placing_verb} {quantity} {article2} {plural_noun} {association_preposition} {article1} {same} {texture} as the {object1} {contain_preposition} it",
    ],
}

# --- fixed values: instruction of another task that fits the same scene ---------------------------
OTHER_INSTRUCTION = {
    "visual_manipulation": "Rotate the {dragged_obj_1} {angle_in_degree} degrees.",
    "sweep_without_exceeding": "Sweep {det} {swept_obj} into {bounds} without touching {constraint}.",
    "sweep_without_touching": "Sweep {det} {swept_obj} into {bounds} without exceeding {constraint}.",
    "same_texture": "Put all objects with the same profile as {base_obj} into it.",
    "same_shape": "Put all objects with the same texture as {base_obj} into it.",
}
OTHER_INSTRUCTION_DEGREES = [30, 60, 90, 120, 150]

# --- fixed values: prompt grammars -----------------------------------------------------------------
GRAMMAR_VERBS = ["put", "place", "move", "position", "drop", "store"]
GRAMMARS: dict[str, dict] = {
    "move_object": {
        "templates": [
            "{lifting_verb} {article1} {object1} {preposition} {article2} {object2}",
            "{placing_verb} {article1} {object1} {preposition} {object2}",
            "{placing_verb} {object1} {preposition} {object2}",
            "{placing_verb} {object1} {preposition} {article1} {object2}",
            "{placing_verb} {article1} {object1} {preposition} {article2} {object2}",
            "{lifting_verb} {object1} and {placing_verb} {preposition} {object2}",
        ],
        "slots": {
            "lifting_verb": LIFTING_VERBS,
            "placing_verb": GRAMMAR_VERBS,
            "article1": ARTICLE,
            "article2": ARTICLE,
            "preposition": PREPOSITIONS,
        },
    },
    "scene_texture": {
        "templates": [
            "{verb1} {article1} {texture1} {plural_noun} in {scene} {preposition} {article2} {texture2} {singular_noun}",
        ],
        "slots": {
            "verb1": GRAMMAR_VERBS,
            "article1": QUANTITIES,
            "article2": ARTICLE,
            "preposition": PREPOSITIONS,
            "singular_noun": SINGULAR_NOUNS,
            "plural_noun": PLURAL_NOUNS,
        },
    },
}
