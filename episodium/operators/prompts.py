"""Prompt transforms.

A transform is a function from DataFrame to DataFrame (``rows.transform(f)``); prompts live in a
``prompt`` column next to ``idx`` and ``task``.  Template sets are fixed data of a hundred
templates, held as one literal: matching a prompt with the templates of its task needs no join, and
rows carry template numbers, never templates.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium import dims
from episodium.functions import text as X
from episodium.functions.keyed import keyed_hash, keyed_int
from episodium.vocabulary import OTHER_INSTRUCTION, OTHER_INSTRUCTION_DEGREES, SINGULAR_NOUNS

Transform = Callable[[DataFrame], DataFrame]


def noop(rows: DataFrame) -> DataFrame:
    """Leave everything as it is."""
    return rows


def chain(*transforms: Transform) -> Transform:
    """One transform after the other."""

    def run(rows: DataFrame) -> DataFrame:
        for transform in transforms:
            rows = rows.transform(transform)
        return rows

    return run


# --- template sets -----------------------------------------------------------------------------

#: A vocabulary of at most so many bytes is broadcast; what a word takes besides its letters.
VOCABULARY_BYTES, WORD_BYTES = 4 << 20, 64
_PIECE = "struct<before:string,slot:string,words:array<string>,keep:boolean,again:int>"
_SLOT = "struct<at:int,slot:string,words:array<string>>"
_TEMPLATE = (
    f"struct<no:int,text:string,n_words:int,slots:array<{_SLOT}>,assets:string,pieces:array<{_PIECE}>,tail:string,"
    f"fixed:string,telling:{_PIECE}>"
)


def _survives(text: str) -> bool:
    """Whether a text inside a wording is still found in it, in lower case, after :func:`X.sentence`."""
    return text != "" and text.isascii() and text == text.strip(" ") and "  " not in text


def template_parts(number: int, text: str, vocabulary: dict[str, list[str]]) -> dict:
    """A template cut up once, so that rows need no parsing.

    ``slots`` tells at which word a slot (its last mention) stands, ``assets`` the marks of
    those that draw no word.  ``pieces`` are the texts before each mention.  A slot that draws a word and is mentioned again sets ``keep`` at its first
    mention; later ones say in ``again`` which kept word they repeat.  ``fixed`` is the longest text, in lower
    case, that every wording has, and ``telling`` the piece that draws from the most words, if there is any;
    see :func:`may_be`.
    """
    slots = {}
    for at, word in enumerate(text.lower().split(" ")):
        word = word.strip().rstrip(".").rstrip(":")
        if word.startswith("{") and word.endswith("}"):
            slots[word[1:-1]] = at
    mentions = re.findall(r"([^{]*)\{([^{}]*)\}", text)
    names = [slot for _, slot in mentions]
    kept = [s for s in dict.fromkeys(names) if names.count(s) > 1 and s in vocabulary]
    pieces = []
    for place, (before, slot) in enumerate(mentions):
        first = names.index(slot) == place
        again = kept.index(slot) if slot in kept and not first else None
        pieces.append(
            {
                "before": before, "slot": slot, "words": vocabulary.get(slot),
                "keep": slot in kept and first, "again": again,
            }
        )
    tail = text[sum(len(before) + len(slot) + 2 for before, slot in mentions) :]
    between = [t for t in (b.strip(" ").lower() for b in [*(p["before"] for p in pieces), tail]) if _survives(t)]
    drawing = [p for p in pieces if p["words"] and all(_survives(w) for w in p["words"])]
    return {
        "no": number,
        "text": text,
        "n_words": len(text.split(" ")),
        "slots": [{"at": at, "slot": slot, "words": vocabulary.get(slot)} for slot, at in slots.items()],
        "assets": "".join("{" + slot + "}" for slot in dict.fromkeys(names) if slot not in vocabulary),
        "pieces": pieces,
        "tail": tail,
        "fixed": max(between, key=len, default=""),
        "telling": max(drawing, key=lambda p: len(p["words"]), default=None),
    }


def template_sets(templates: dict[str, list[str]], slots: dict[str, dict[str, list[str]]]) -> Column:
    """The templates of a row's task, cut up; NULL if the task has none."""
    by_task: list[list[dict] | None] = [None] * (max(dims.TASKS.values()) + 1)
    for task, texts in templates.items():
        vocabulary = slots.get(task, {})
        by_task[dims.TASKS[task]] = [template_parts(i, text, vocabulary) for i, text in enumerate(texts)]
    return F.get(F.from_json(F.lit(json.dumps(by_task)), f"array<array<{_TEMPLATE}>>"), F.col("task"))


def keyed_number(templates: Column, seed: object, *key: Column) -> Column:
    """Number of a keyed one of the templates; NULL if there is none.

    Spark copies what a lambda returns, so this one returns the number and not the template.
    """
    place = lambda t: keyed_int(F.greatest(F.size(t), F.lit(1)), seed, *key).cast("int")
    return X.let(templates, lambda t: F.get(t, place(t))["no"])


def least_number(templates: Column, seed: object, *key: Column) -> Column:
    """Number of the template whose own keyed digest is smallest; NULL if there is none."""
    drawn = F.transform(
        templates, lambda t: F.struct(keyed_hash(seed, *key, t["no"]).alias("h"), t["no"].alias("no"))
    )
    return F.array_min(drawn)["no"]


def picked_word(piece: Column, seed: object, *key: Column) -> Column:
    """A keyed word of the piece's vocabulary; NULL if it has none."""
    return F.when(piece["words"].isNotNull(), X.pick_from(piece["words"], seed, *key, piece["slot"]))


def opened(slot: Column) -> Column:
    """``{slot}`` of a slot's name."""
    return F.concat(F.lit("{"), slot, F.lit("}"))


def left_open(piece: Column) -> Column:
    """``{slot}`` itself, for a slot without a value."""
    return opened(piece["slot"])


def written(template: Column, value) -> Column:
    """Template with ``value(piece)`` in its slots."""
    filled = F.transform(template["pieces"], lambda p: F.concat(p["before"], value(p)))
    return F.concat(F.array_join(filled, ""), template["tail"])


def generate(rows: DataFrame, sets: Column, assets: Column, seed: object, draw=keyed_number) -> DataFrame:
    """Prompts from a keyed template, keyed slot words and given asset expressions.

    ``draw`` says how a template is drawn: :func:`keyed_number` or :func:`least_number`.  A row whose
    task has no template keeps a NULL prompt.
    """
    key = F.col("idx")
    chosen = rows.withColumn("__no", draw(sets, seed, key))
    text = X.let(
        assets,
        lambda known: written(
            F.get(sets, F.col("__no")),
            lambda p: F.coalesce(
                picked_word(p, seed, key), F.try_element_at(known, p["slot"]), left_open(p)
            ),
        ),
    )
    return chosen.withColumn("prompt", X.sentence(text)).drop("__no")


# --- matching a prompt with its template ----------------------------------------------------------


def mask_textures(prompt: Column, textures: Column) -> Column:
    """Prompt with texture mentions as ``{texture_0}``, ``{texture_1}``, …, longest names first.

    Returns a struct of the masked text and the masked names in order.
    """
    longest_first = F.transform(
        F.array_sort(
            F.transform(
                textures, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))
            )
        ),
        lambda p: p["t"],
    )
    start = F.struct(prompt.alias("text"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, name: Column) -> Column:
        at = F.instr(state["text"], name)
        mark = F.concat(F.lit("{texture_"), F.size(state["names"]).cast("string"), F.lit("}"))
        return F.when(
            at > 0,
            F.struct(
                F.concat(
                    F.substring(state["text"], F.lit(1), at - 1),
                    mark,
                    F.substring(state["text"], at + F.length(name), F.length(state["text"])),
                ).alias("text"),
                F.concat(state["names"], F.array(name)).alias("names"),
            ),
        ).otherwise(state)

    mentioned = F.exists(textures, lambda t: F.contains(prompt, t))
    return F.when(mentioned, F.aggregate(longest_first, start, step)).otherwise(start)


def unmask(word: Column, names: Column) -> Column:
    """A word with its ``{texture_n}`` marks replaced by the names again."""
    marked = F.contains(word, F.lit("{texture_"))
    named = F.aggregate(
        F.transform(names, lambda n, i: F.struct(i.alias("i"), n.alias("n"))),
        word,
        lambda acc, p: F.replace(acc, F.concat(F.lit("{texture_"), p["i"].cast("string"), F.lit("}")), p["n"]),
    )
    return F.when(marked, named).otherwise(word)


def fits(template: Column, words: Column) -> Column:
    """Same number of words, and each slot with a vocabulary holds one of its words."""
    return (F.size(words) == template["n_words"]) & F.forall(
        template["slots"],
        lambda s: s["words"].isNull() | F.array_contains(s["words"], F.get(words, s["at"])),
    )


def slot_values(
    rows: DataFrame, sets: Column, seed: object, textures: Column | None = None, draw=keyed_number
) -> DataFrame:
    """Rows with the number of the template that fits (``matched``, NULL if none does) and the slot
    words found (``values``).

    Several templates may fit; a keyed one is taken.
    """
    names = textures if textures is not None else F.array().cast("array<string>")
    masked = rows.withColumn("__masked", mask_textures(F.col("prompt"), names)).withColumn(
        "__words", X.prompt_words(F.col("__masked.text"))
    )
    # drawn inside, so that no templates leave the lambda, which would copy them
    number = X.let(
        F.col("__words"), lambda words: draw(F.filter(sets, lambda t: fits(t, words)), seed, F.col("idx"))
    )
    matched = masked.withColumn("matched", number)
    found = F.get(sets, F.col("matched"))["slots"]
    values = X.let(
        F.col("__words"),
        lambda words: X.let(
            F.col("__masked.names"),
            lambda masked_names: F.map_from_entries(
                F.transform(
                    found, lambda s: F.struct(s["slot"], unmask(F.get(words, s["at"]), masked_names))
                )
            ),
        ),
    )
    return matched.withColumn("values", values).drop("__masked", "__words")


def required_slots(prompt: Column) -> Column:
    """Asset placeholders of a prompt."""
    return F.array_distinct(X.slots_in(prompt))


def carriers(required: Column, values: Column) -> Column:
    """For each required placeholder the ``{slot}`` marks that bring it in: by their value, or by being open.

    Vocabulary words and the text between slots hold no placeholders, so a template keeps them all
    if its asset slots meet each of these lists; they are made once for all templates of a row.
    """

    entries = F.transform(
        F.map_entries(values), lambda e: F.struct(opened(e["key"]).alias("mark"), F.lower(e["value"]).alias("text"))
    )

    def bringing(known: Column, mark: Column) -> Column:
        by_value = F.transform(F.filter(known, lambda e: F.contains(e["text"], mark)), lambda e: e["mark"])
        unknown = ~F.exists(known, lambda e: e["mark"] == mark)
        return F.when(unknown, F.concat(by_value, F.array(mark))).otherwise(by_value)

    return X.let(
        entries, lambda known: F.transform(F.transform(required, opened), lambda mark: bringing(known, mark))
    )


def keeps(template: Column, carried: Column) -> Column:
    """Whether every required placeholder is in some slot of a template, see :func:`carriers`."""
    return F.forall(carried, lambda marks: F.exists(marks, lambda m: F.contains(template["assets"], m)))


def may_be(template: Column, original: Column, drawn=None) -> Column:
    """False only for templates whose wording is not ``original``, a text in lower case.

    Such a wording lacks nothing that every wording of the template has, nor the word that
    ``drawn(piece)`` gives for its telling piece; most templates fall out without being written.
    """
    fixed = F.contains(original, template["fixed"])
    if drawn is None:
        return fixed
    telling = template["telling"]
    return fixed & (telling.isNull() | F.contains(original, F.lower(drawn(telling))))


def _choose(
    known: DataFrame, sets: Column, seed: object, value, allow_original: bool, required: Column | None = None,
    draw=keyed_number, drawn=None,
) -> DataFrame:
    """Draw a template among the valid ones and write it; ``value(piece, values)`` fills a slot.

    ``drawn(piece)`` is the word of a slot that has a vocabulary, if that does not depend on the prompt.
    """

    def valid(values: Column, carried: Column, original: Column) -> Column:
        kept = F.filter(sets, lambda t: keeps(t, carried))
        if allow_original:
            return kept
        same = lambda t: F.lower(X.sentence(written(t, lambda p: value(p, values)))) == original
        return F.filter(kept, lambda t: ~(may_be(t, original, drawn) & same(t)))

    numbers = X.let(
        F.col("values"),
        lambda v: X.let(
            carriers(required_slots(F.col("prompt")) if required is None else required, v),
            lambda c: X.let(
                F.lower("prompt"),
                lambda o: draw(valid(v, c, o), f"{seed}-template", F.col("idx")),
            ),
        ),
    )
    chosen = known.withColumn("__no", F.when(F.col("matched").isNotNull(), numbers))
    text = X.let(
        F.col("values"), lambda v: written(F.get(sets, F.col("__no")), lambda p: value(p, v))
    )
    status = (
        F.when(F.col("matched").isNull(), F.lit("no template fits"))
        .when(F.col("__no").isNull(), F.lit("no valid wording"))
        .otherwise(F.lit("ok"))
    )
    return (
        chosen.withColumn("status", status)
        .withColumn("prompt", X.drop_adverb(X.sentence(text)))
        .drop("__no", "matched", "values")
    )


def _kept(piece: Column, values: Column) -> Column:
    """The prompt's own value for a slot, or the open slot."""
    return F.coalesce(F.try_element_at(values, piece["slot"]), left_open(piece))


def reword(
    rows: DataFrame,
    sets: Column,
    seed: object,
    textures: Column | None = None,
    allow_original: bool = True,
    required: Column | None = None,
) -> DataFrame:
    """New wording for each prompt; ``prompt`` is NULL and ``status`` tells why when there is none.

    Slot words are drawn anew, asset values are kept, and the template is drawn among those that
    keep every ``required`` placeholder: the names of the prompt's assets, or if not given those the
    prompt mentions.
    """
    known = slot_values(rows, sets, seed, textures)

    def drawn(piece: Column) -> Column:
        return picked_word(piece, f"{seed}-words", F.col("idx"))

    def value(piece: Column, values: Column) -> Column:
        return F.coalesce(drawn(piece), _kept(piece, values))

    return _choose(known, sets, seed, value, allow_original, required, drawn=drawn)


def most_choices(templates: dict[str, list[str]], slots: dict[str, dict[str, list[str]]]) -> int:
    """Most mentions of drawn slots in any template."""
    return max(
        sum(text.count("{" + slot + "}") for slot in slots[task])
        for task, texts in templates.items()
        for text in texts
    )


def all_wordings(
    rows: DataFrame,
    sets: Column,
    seed: object,
    mentions: int,
    textures: Column | None = None,
    required: Column | None = None,
) -> DataFrame:
    """Every distinct valid wording per task.

    Each template grows piece by piece, so only the slots it uses multiply, once per distinct set
    of asset values.  ``mentions`` is the most mentions of drawn slots in any template.
    """
    required = required_slots(F.col("prompt")) if required is None else required
    known = slot_values(rows, sets, seed, textures).where(F.col("matched").isNotNull())
    scenes = known.select(
        "task",
        F.array_sort(F.map_entries("values")).alias("found"),
        F.array_sort(required).alias("required"),
    ).distinct()
    one_each = (
        scenes.withColumn("values", F.map_from_entries("found"))
        .select("task", "required", "values", F.explode(sets).alias("template"))
    )
    asset = lambda p: F.coalesce(F.try_element_at("values", p["slot"]), left_open(p))
    # drawn words hold no placeholders, so the check needs no drawn words
    outline = X.sentence(
        written(F.col("template"), lambda p: F.when(p["words"].isNotNull(), F.lit("x")).otherwise(asset(p)))
    )
    fixed = F.array_distinct(
        F.transform(
            F.filter("template.pieces", lambda p: p["words"].isNull()),
            lambda p: F.struct(p["slot"].alias("key"), asset(p).alias("value")),
        )
    )
    checked = (
        one_each.where(X.only_expected_slots(X.drop_adverb(outline), F.col("required")))
        .withColumn("fixed", fixed)
        .withColumn("no", F.col("template.no"))
        .dropDuplicates(["task", "no", "fixed"])
    )
    grown = grow(checked.withColumn("values", F.map_from_entries("fixed")), ["task"], mentions)
    finished = X.drop_adverb(X.sentence(F.col("text")))
    return grown.select("task", finished.alias("prompt")).distinct()


_STEP = "struct<before:string,words:array<string>,keep:boolean,again:int>"


def open_pieces(template: Column, values: Column) -> Column:
    """Pieces with a choice of words (or a word to repeat), and the text after the last of them.

    Pieces without a choice become part of the text before the next one.
    """

    def step(state: Column, piece: Column) -> Column:
        before = F.concat(state["text"], piece["before"])
        value = F.coalesce(
            F.when(F.size(piece["words"]) == 1, F.get(piece["words"], F.lit(0))),
            F.try_element_at(values, piece["slot"]),
            left_open(piece),
        )
        choice = F.struct(before.alias("before"), piece["words"].alias("words"), piece["keep"].alias("keep"), F.lit(None).cast("int").alias("again"))
        repeat = F.struct(before.alias("before"), F.lit(None).cast("array<string>").alias("words"), F.lit(False).alias("keep"), piece["again"].alias("again"))
        added = lambda one: F.struct(F.lit("").alias("text"), F.concat(state["steps"], F.array(one.cast(_STEP))).alias("steps"))
        plain = F.struct(F.concat(before, value).alias("text"), state["steps"].alias("steps"))
        return (
            F.when(piece["again"].isNotNull(), added(repeat))
            .when((F.size(piece["words"]) > 1) | piece["keep"], added(choice))
            .otherwise(plain)
            .cast(f"struct<text:string,steps:array<{_STEP}>>")
        )

    start = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{_STEP}>").alias("steps"))
    return F.aggregate(
        template["pieces"],
        start,
        step,
        lambda state: F.struct(F.concat(state["text"], template["tail"]).alias("text"), state["steps"].alias("steps")),
    )


def grow(rows: DataFrame, keep: list[str], mentions: int) -> DataFrame:
    """Expand ``template`` into ``text`` for every choice of words; ``values`` fill the other slots.

    Each piece is a plain ``explode``; what a finished piece needed is dropped from the row.  A few
    rows become very many, so they are spread over a fixed number of tasks on the way.
    """
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = rows.withColumn("__open", open_pieces(F.col("template"), F.col("values"))).select(
        *keep,
        *[F.get("__open.steps", F.lit(i)).alias(f"p{i}") for i in range(mentions)],
        F.col("__open.text").alias("tail"),
        F.lit("").alias("text"),
        F.array().cast("array<string>").alias("had"),
    )
    for place in range(mentions):
        if place in (1, 3):
            state = state.repartition(parallel, *keep, "tail", "text")
        p = f"p{place}"
        later = [f"p{i}" for i in range(place + 1, mentions)]
        again = F.array(F.coalesce(F.get("had", F.col(f"{p}.again")), F.lit("")))
        state = state.select(
            *keep, *later, "tail", "text", "had",
            F.coalesce(f"{p}.before", F.lit("")).alias("__b"), F.col(f"{p}.keep").alias("__k"),
            F.explode(F.coalesce(f"{p}.words", again)).alias("__w"),
        ).select(
            *keep, *later, "tail",
            F.concat("text", "__b", "__w").alias("text"),
            F.when(F.col("__k"), F.concat("had", F.array("__w"))).otherwise(F.col("had")).alias("had"),
        )
    return state.select(*keep, F.concat("text", "tail").alias("text"))


# --- nonsense -------------------------------------------------------------------------------------


def is_plain(word: Column) -> Column:
    """Words that may change: everything that does not open a placeholder."""
    return ~word.startswith("{")


def nonsense_words(seed: object, apart: bool = False) -> Transform:
    """Each plain word becomes keyed letters of the same number, then plain words swap places.

    With ``apart`` each word and each place has digests of its own, otherwise parts of its row's.
    """

    def run(rows: DataFrame) -> DataFrame:
        key = F.col("idx")
        own = lambda w, i: F.when(is_plain(w), X.nonsense_word(F.length(w), seed, key, i)).otherwise(w)
        scrambled = X.let(
            X.words(F.col("prompt")),
            lambda words: F.transform(words, own) if apart else X.nonsense(words, is_plain, seed, key),
        )
        return (
            rows.withColumn("__w", scrambled)
            .withColumn(
                "prompt",
                F.array_join(X.shuffle_unlocked(F.col("__w"), is_plain, f"{seed}-order", key, apart=apart), " "),
            )
            .drop("__w")
        )

    return run


PIECE = r"[\s\S]{1,4}"


def pieces(word: Column) -> Column:
    """Tokens of a word: runs of up to four characters; a placeholder is one special token."""
    return F.when(is_plain(word), F.regexp_extract_all(word, F.lit(PIECE), F.lit(0))).otherwise(
        F.array(word)
    )


def n_pieces(word: Column) -> Column:
    """How many :func:`pieces` a word has, an empty word none, without making them."""
    return F.when(is_plain(word), F.ceil(F.length(word) / 4).cast("int")).otherwise(F.lit(1))


def token_rows(rows: DataFrame) -> DataFrame:
    """One row per token with its word and place; words without characters have one empty token."""
    words = rows.select("idx", F.posexplode(X.words(F.col("prompt"))).alias("word_no", "word"))
    tokens = F.when(F.length("word") == 0, F.array(F.lit(""))).otherwise(pieces(F.col("word")))
    return words.select(
        "idx", "word_no", F.startswith("word", F.lit("{")).alias("special"), F.posexplode(tokens).alias("piece_no", "token")
    )


def nonsense_tokens(vocabulary: DataFrame, seed: object, apart: bool = False) -> Transform:
    """Each plain word's tokens become keyed vocabulary tokens of the same number, then words swap.

    The vocabulary may be large: tokens meet it in a join on the drawn id, which is evenly spread.
    ``apart`` as in :func:`nonsense_words`, for the places.
    """

    def run(rows: DataFrame) -> DataFrame:
        size = vocabulary.agg(F.count(F.lit(1))).scalar()
        tokens = token_rows(rows).withColumn(
            "token_id",
            F.when(
                ~F.col("special") & (F.col("token") != ""),
                keyed_int(size, seed, "idx", "word_no", "piece_no"),
            ),
        )
        drawn = tokens.join(
            vocabulary.select("token_id", F.col("token").alias("drawn")), "token_id", "left"
        ).withColumn("new", F.coalesce("drawn", "token"))
        words = drawn.groupBy("idx", "word_no").agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "new"))), lambda p: p["new"]), ""
            ).alias("word"),
            F.max("special").alias("special"),
        )
        rebuilt = words.groupBy("idx").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("word_no", "word", "special"))),
                lambda p: F.struct(p["word"].alias("word"), p["special"].alias("special")),
            ).alias("__items")
        )
        shuffled = X.shuffle_unlocked(
            F.col("__items"), lambda p: ~p["special"], f"{seed}-order", F.col("idx"), apart=apart
        )
        return (
            rows.drop("prompt")
            .join(rebuilt, "idx")
            .withColumn("prompt", F.array_join(F.transform(shuffled, lambda p: p["word"]), " "))
            .drop("__items")
        )

    return run


# --- descriptions and other instructions ---------------------------------------------------------


def describe(assets: Column, mode: str | None, seed: object, key: Column) -> Column:
    """Text per single-object asset.  Modes drop or blur the noun or the texture."""
    single = F.map_filter(assets, lambda _, d: F.size(d) == 1)

    def text(name: Column, d: Column) -> Column:
        first = d[0]
        if mode == "underspecify_nouns":
            generic = X.pick_from(F.array(*[F.lit(n) for n in SINGULAR_NOUNS]), seed, key, name)
            return F.concat_ws(" ", first["texture"], generic)
        if mode == "remove_textures":
            return first["name"]
        if mode == "remove_nouns":
            return first["texture"]
        return F.concat_ws(" ", first["texture"], first["name"])

    return F.transform_values(single, text)


def textual(sets: Column, seed: object, mode: str | None = None, draw=keyed_number) -> Transform:
    """Placeholders of single objects become words.

    Tasks that would make no sense are left alone; tasks with word-order templates are first
    rewritten with another such template, keeping every known value.
    """

    def run(rows: DataFrame) -> DataFrame:
        avoided = F.col("task").isin([dims.TASKS[t] for t in dims.TASKS_KEPT_VISUAL])
        known = slot_values(rows, sets, seed, draw=draw).withColumn("original", F.col("prompt"))
        value = lambda p, values: F.coalesce(
            F.try_element_at(values, p["slot"]), picked_word(p, f"{seed}-words", F.col("idx")), left_open(p)
        )
        ordered = known.withColumn("__fixed_order", sets.isNotNull())
        chosen = _choose(ordered, sets, seed, value, allow_original=False, draw=draw)
        base = F.when(F.col("__fixed_order"), F.col("prompt")).otherwise(F.col("original"))
        text = X.substitute(base, describe(F.col("assets"), mode, seed, F.col("idx")))
        return chosen.select(
            *[c for c in rows.columns if c != "prompt"],
            F.when(avoided, F.col("original")).otherwise(text).alias("prompt"),
            F.when(avoided, F.lit("avoided"))
            .when(~F.col("__fixed_order"), F.lit("ok"))
            .otherwise(F.col("status"))
            .alias("status"),
        )

    return run


def other_instruction(seed: object) -> Transform:
    """Instruction of another task for the same scene; tasks without one are reported.

    Words of the old prompt fill the slots at their places, and only assets the new template names
    are kept.
    """

    def run(rows: DataFrame) -> DataFrame:
        by_task = [F.lit(x) for t, text in OTHER_INSTRUCTION.items() for x in (dims.TASKS[t], text)]
        degrees = X.pick_from(
            F.array(*[F.lit(str(d)) for d in OTHER_INSTRUCTION_DEGREES]), seed, F.col("idx")
        )
        template = F.replace(
            F.try_element_at(F.create_map(*by_task), F.col("task")), F.lit("{angle_in_degree}"), degrees
        )
        planned = rows.withColumn("__t", template).withColumn(
            "__v", X.extract_slots(F.col("prompt"), F.col("__t"), strict=False)
        )
        named = F.transform(
            F.filter(X.template_words(F.col("__t")), X.is_slot), X.slot_name
        )
        return planned.select(
            *[c for c in rows.columns if c not in ("prompt", "assets")],
            X.sentence(X.substitute(F.col("__t"), F.col("__v"))).alias("prompt"),
            F.map_filter("assets", lambda k, _: F.array_contains(named, k)).alias("assets"),
            F.when(F.col("__t").isNull(), F.lit("not supported")).otherwise(F.lit("ok")).alias("status"),
        )

    return run


def expand_grammar(objects: DataFrame, templates: list[str], slots: dict[str, list[str]]) -> DataFrame:
    """Every distinct prompt of a grammar for each row of given slot ``values``."""
    parts = [template_parts(i, text, slots) for i, text in enumerate(templates)]
    literal = F.from_json(F.lit(json.dumps(parts)), f"array<{_TEMPLATE}>")
    most = most_choices({"grammar": templates}, {"grammar": slots})
    rows = objects.select("values", F.explode(literal).alias("template"))
    return grow(rows, [], most).select(F.col("text").alias("prompt")).distinct()


# --- statistics and encoding -----------------------------------------------------------------------


def placeholder_tokens() -> list[str]:
    """Special tokens: each asset name, and its numbered forms where it is numbered."""
    tokens = []
    for name, highest in dims.ASSET_PLACEHOLDERS.items():
        tokens.append("{" + name + "}")
        if highest:
            tokens += ["{%s_%d}" % (name, i) for i in range(highest + 1)]
    return tokens


def length_statistics(rows: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of words and tokens per variant."""
    words = X.words(F.col("prompt"))
    tokens = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.greatest(n_pieces(w), F.lit(1)))
    sized = rows.select("variant", F.size(words).alias("w"), tokens.alias("k"))
    return sized.groupBy("variant").agg(
        F.avg("w").alias("mean_words"),
        F.stddev_samp("w").alias("std_words"),
        F.avg("k").alias("mean_tokens"),
        F.stddev_samp("k").alias("std_tokens"),
    )


def few_words(vocabulary: DataFrame) -> bool:
    """Whether a vocabulary, which is read for that, takes at most ``VOCABULARY_BYTES``."""
    size = vocabulary.agg(F.sum(F.octet_length("token") + F.lit(WORD_BYTES)).alias("n")).first()["n"]
    return (size or 0) <= VOCABULARY_BYTES


def encode(tokens: DataFrame, vocabulary: DataFrame, salts: int = 16, few: bool = False) -> DataFrame:
    """Token ids by a join that stays even when one token makes up much of the text.

    Frequent tokens are spread over ``salts`` join keys; the vocabulary, one row per distinct
    token, is copied that many times.  One of ``few`` words is broadcast, and tokens stay where they are.
    """
    if few:
        return tokens.join(F.broadcast(vocabulary.select("token", "token_id")), "token", "left")
    spread = tokens.withColumn("__salt", F.pmod(F.xxhash64(*tokens.columns), F.lit(salts)).cast("int"))
    copies = vocabulary.select(
        "token", "token_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")
    )
    return spread.join(copies, ["token", "__salt"], "left").drop("__salt")


def max_prompt_length(types: DataFrame, objects_per_image: int, by: str) -> DataFrame:
    """Longest prompt per group when a word takes one place and an image one per object."""
    width = F.when(F.col("type") == 0, F.lit(1)).otherwise(F.lit(objects_per_image))
    lengths = types.groupBy(by, "idx").agg(F.sum(width).alias("length"))
    return lengths.groupBy(by).agg(F.max("length").alias("max_length"))
