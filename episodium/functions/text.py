"""Prompt text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from episodium.functions.keyed import keyed_hash, keyed_int, long_hash

NOT_LETTERS = "0123456789+/="  # what base 64 has besides the 52 letters


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it.

    Also needed for computed columns inside a lambda: the optimizer may move the computation of a
    column that is mentioned once into the lambda, where it would run for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Text split at single spaces; double spaces leave empty words."""
    return F.split(text, " ")


def bare(word: Column) -> Column:
    """Word without dots, then colons, at its end."""
    cut = F.rtrim(F.rtrim(word, F.lit(".")), F.lit(":"))
    return F.when(F.endswith(word, F.lit(".")) | F.endswith(word, F.lit(":")), cut).otherwise(word)


def is_slot(word: Column) -> Column:
    """Whether a bare word is a ``{slot}``."""
    return word.startswith("{") & word.endswith("}")


def slot_name(word: Column) -> Column:
    """``{slot}`` without its braces."""
    return F.substring(word, F.lit(2), F.length(word) - 2)


def template_words(template: Column) -> Column:
    """Template words as compared with prompt words: lower case, trimmed, bare."""
    return F.transform(words(F.lower(template)), lambda w: bare(F.trim(w)))


def prompt_words(prompt: Column) -> Column:
    """Prompt words as compared with template words."""
    return F.transform(words(F.lower(prompt)), bare)


def slots_in(text: Column) -> Column:
    """Names of all ``{slot}`` marks in a text, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(r"\{([^{}]*)\}"), F.lit(1))


def extract_slots(prompt: Column, template: Column, strict: bool = True) -> Column:
    """Map from slot to the prompt word at the slot's place.

    A slot that occurs twice keeps its last word.  With ``strict`` a different number of words
    gives NULL; otherwise the longer side is cut.
    """

    def last_words(found: Column) -> Column:
        kept = F.filter(
            found,
            lambda p, i: ~F.exists(
                F.slice(found, i + 2, F.size(found)), lambda q: q["slot"] == p["slot"]
            ),
        )
        return F.map_from_entries(
            F.transform(kept, lambda p: F.struct(slot_name(p["slot"]), p["word"]))
        )

    def pairs(left: Column, right: Column) -> Column:
        either = F.sequence(F.lit(1), F.least(F.size(left), F.size(right)))
        zipped = F.transform(
            either,
            lambda n: F.struct(F.get(left, n - 1).alias("slot"), F.get(right, n - 1).alias("word")),
        )
        return F.filter(zipped, lambda p: is_slot(p["slot"]))

    def extract(left: Column, right: Column) -> Column:
        mapped = let(pairs(left, right), last_words)
        return F.when(F.size(left) == F.size(right), mapped) if strict else mapped

    return let(template_words(template), lambda a: let(prompt_words(prompt), lambda b: extract(a, b)))


def substitute(template: Column, values: Column) -> Column:
    """Template with every known ``{slot}`` replaced by its value, in one sweep.

    Unknown slots stay.  Values are not searched for slots again.
    """
    pieces = F.split(template, r"\{")

    def filled(piece: Column, known: Column) -> Column:
        name = F.substring_index(piece, "}", 1)
        value = F.coalesce(F.try_element_at(known, name), F.concat(F.lit("{"), name, F.lit("}")))
        rest = F.substring(piece, F.instr(piece, "}") + 1, F.length(piece))
        return F.when(F.instr(piece, "}") > 0, F.concat(value, rest)).otherwise(F.concat(F.lit("{"), piece))

    return let(
        values,
        lambda known: F.array_join(
            F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(filled(piece, known))), ""
        ),
    )


def sentence(text: Column) -> Column:
    """Trimmed, first letter upper case and the rest lower case, one final dot, single spaces."""
    cased = let(
        F.trim(text),
        lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t)))),
    )
    dotted = let(cased, lambda c: F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit("."))))
    return F.replace(dotted, F.lit("  "), F.lit(" "))


def drop_adverb(text: Column) -> Column:
    """Text without an unfilled ``{adv}`` and the double space it leaves."""
    return F.replace(F.replace(text, F.lit("{adv}"), F.lit("")), F.lit("  "), F.lit(" "))


def fill(template: Column, values: Column) -> Column:
    """Finished prompt from a template and slot values."""
    return drop_adverb(sentence(substitute(template, values)))


def has_all_slots(prompt: Column, required: Column) -> Column:
    """Whether every required slot is still marked in the prompt."""
    return let(
        prompt,
        lambda text: F.forall(
            required, lambda p: F.contains(text, F.concat(F.lit("{"), p, F.lit("}")))
        ),
    )


def only_expected_slots(prompt: Column, required: Column) -> Column:
    """Whether each word that opens a slot names an expected one."""
    opened = F.filter(words(prompt), lambda w: w.startswith("{"))
    return let(
        required,
        lambda names: F.forall(opened, lambda w: F.array_contains(names, slot_name(bare(F.trim(w))))),
    )


def letter_stream(length: Column, seed: object, *key: Column) -> Column:
    """As many keyed letters as wanted: those of digests in base 64, one digest for 32 letters.

    A digest holds some 36; if they are fewer than wanted in all, they repeat.
    """
    blocks = F.sequence(F.lit(0), F.floor(length / 32).cast("int"))
    letters = F.array_join(
        F.transform(
            blocks, lambda block: F.translate(F.base64(F.unhex(long_hash(seed, *key, block))), NOT_LETTERS, "")
        ),
        "",
    )
    return let(letters, lambda x: F.rpad(x, length, x))


def nonsense(items: Column, plain, seed: object, *key: Column) -> Column:
    """Words of which the ``plain`` ones become keyed letters, as many as they have.

    A row's letters are one stream, which its words take in order.
    """
    sizes = F.transform(items, lambda w: F.when(plain(w), F.length(w)).otherwise(0))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))

    def placed(lengths: Column) -> Column:
        return F.aggregate(
            lengths, start, lambda s, n: F.struct(F.concat(s["at"], F.array(s["n"])).alias("at"), (s["n"] + n).alias("n"))
        )

    def written(places: Column, stream: Column) -> Column:
        return F.transform(
            items,
            lambda w, i: F.when(plain(w), F.substring(stream, F.get(places["at"], i) + 1, F.length(w))).otherwise(w),
        )

    return let(
        sizes, lambda n: let(placed(n), lambda p: let(letter_stream(p["n"], seed, *key), lambda letters: written(p, letters)))
    )


def nonsense_word(length: Column, seed: object, *key: Column) -> Column:
    """Keyed letters, as many as the word has.

    The letters are those of a digest in base 64; a digest holds about 18, one is taken per eight
    letters wanted.
    """
    letters = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.floor(length / 8).cast("int")),
            lambda block: F.translate(F.base64(F.unhex(keyed_hash(seed, *key, block))), NOT_LETTERS, ""),
        ),
        "",
    )
    return F.when(length > 0, let(letters, lambda x: F.rpad(x, length, x))).otherwise(F.lit(""))


def shuffle_unlocked(items: Column, unlocked, seed: object, *key: Column, apart: bool = False) -> Column:
    """Items in keyed order among the places of unlocked items; locked items stay put.

    ``unlocked`` tells from an item whether it may move.  With ``apart`` each place has a whole digest
    of its own, otherwise a slice of one.
    """

    def place(free: Column, order: Column) -> Column:
        moves = F.map_from_entries(
            F.transform(free, lambda p, k: F.struct(p["i"], F.get(order, k)["w"]))
        )
        return let(
            moves, lambda m: F.transform(items, lambda w, i: F.coalesce(F.try_element_at(m, i), w))
        )

    def in_order(free: Column) -> Column:
        if apart:
            own = lambda p: F.struct(keyed_hash(seed, *key, p["i"]).alias("h"), p["i"].alias("i"), p["w"].alias("w"))
            return F.array_sort(F.transform(free, own))
        # a slice of a digest for each place, so that a digest serves 16 of them
        blocks = F.sequence(F.lit(0), F.floor(F.size(items) / 16).cast("int"))
        digests = F.transform(blocks, lambda block: long_hash(seed, *key, block))

        def of(place: Column, known: Column) -> Column:
            return F.substring(F.get(known, F.floor(place / 16).cast("int")), place % 16 * 4 + 1, F.lit(4))

        return let(
            digests,
            lambda known: F.array_sort(
                F.transform(
                    free, lambda p: F.struct(of(p["i"], known).alias("h"), p["i"].alias("i"), p["w"].alias("w"))
                )
            ),
        )

    numbered = F.transform(items, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    free = F.filter(numbered, lambda p: unlocked(p["w"]))
    return let(free, lambda f: let(in_order(f), lambda o: place(f, o)))


def pick_from(options: Column, seed: object, *key: Column) -> Column:
    """A keyed choice from an array."""
    return F.get(options, keyed_int(F.size(options), seed, *key).cast("int"))


def prefixes_of(parts: Column) -> Column:
    """Every non-empty beginning of an array, joined."""
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "")
    )
