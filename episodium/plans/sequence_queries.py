"""Token sequences and collation bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodium import dims
from episodium.functions import nested
from episodium.functions.arrays import pad_to
from episodium.operators import datasets as ds
from episodium.operators import sequences as sq
from episodium.operators.preprocess import end_effector_code
from episodium.plans import bindings as b
from episodium.plans.dataset_queries import BATCHES, batches
from episodium.plans.registry import query
from episodium.workspace import settle


@query(
    "w6_stitched_tokens",
    f"""WITH {b.STEPS} SELECT idx, t * 3 AS position, 'observation' AS kind, part AS token FROM steps
    UNION ALL SELECT idx, t * 3 + 1, 'observation', supp FROM steps
    UNION ALL SELECT idx, t * 3 + 2, 'action', CAST(qty AS BIGINT) FROM steps""",
)
def w6(spark, folder):
    steps = b.steps(spark, folder)
    observations = steps.select("idx", "t", F.posexplode(F.array("part", "supp")).alias("q", "token"))
    actions = steps.select("idx", "t", F.lit(0).alias("q"), F.col("qty").cast("bigint").alias("token"))
    return sq.stitch(observations, actions, 2, 1)


@query(
    "w6_stitchable_episodes",
    """SELECT l_orderkey AS idx, count(*) AS n_obs, count(*) FILTER (l_quantity > 5) AS n_actions,
      count(*) - count(*) FILTER (l_quantity > 5) IN (0, 1) AS ok FROM lineitem GROUP BY l_orderkey""",
)
def w6_check(spark, folder):
    rows = b.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("idx"), "l_quantity")
    return sq.check_stitchable(rows, rows.where("l_quantity > 5"))


IMAGE_TOKENS = 4


@query(
    "w7_assembled_prompts",
    f"""WITH words AS (SELECT conv_id, turn AS position, unnest(string_split(text, ' ')) AS token, unnest(range(0, len(string_split(text, ' ')))) AS sub, true AS valid
      FROM conversations WHERE role <> 'assistant'),
    images AS (SELECT conv_id, turn AS position, 'image' AS token, q AS sub, q <= length(text) % {IMAGE_TOKENS} AS valid
      FROM (SELECT *, unnest(range(0, {IMAGE_TOKENS})) AS q FROM conversations WHERE role = 'assistant')),
    placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY position, sub) - 1 AS pos, token, NOT valid AS masked FROM (SELECT * FROM words UNION ALL SELECT * FROM images)),
    size AS (SELECT conv_id // 8 AS batch, max(pos) AS longest FROM placed GROUP BY ALL), last AS (SELECT conv_id, max(pos) AS last FROM placed GROUP BY conv_id)
    SELECT conv_id // 8 AS batch, conv_id, pos, token, masked FROM placed
    UNION ALL SELECT batch, conv_id, unnest(range(last + 1, longest + 1)) AS pos, 'pad', true FROM last JOIN size ON batch = conv_id // 8""",
)
def w7(spark, folder):
    turns = b.table(spark, folder, "conversations").withColumn("position", F.col("turn"))
    words = turns.where("role <> 'assistant'").select(
        "conv_id", "position", F.posexplode(F.split("text", " ")).alias("sub", "token"), F.lit(True).alias("valid")
    )
    images = turns.where("role = 'assistant'").select(
        "conv_id", "position", F.explode(F.sequence(F.lit(0), F.lit(IMAGE_TOKENS - 1))).alias("sub"),
        F.lit("image").alias("token"), (F.length("text") % IMAGE_TOKENS).alias("top"),
    )
    images = images.withColumn("valid", F.col("sub") <= F.col("top"))
    placed = sq.assemble_prompt(words, images, ["conv_id"]).withColumn("batch", F.floor(F.col("conv_id") / 8))
    placed = settle(placed, "placed")
    padded = sq.pad_rows(
        placed, "batch", ["conv_id"], "at", {"token": F.lit("pad"), "masked": F.lit(True)}
    )
    return padded.withColumnRenamed("at", "pos")


@query(
    "m8_collated_batches",
    f"""WITH {b.STEPS}, {BATCHES}, rows AS (SELECT batch, slot, t, qty AS value FROM steps JOIN batches USING (idx)),
    last AS (SELECT batch, slot, max(t) AS last FROM rows GROUP BY ALL), size AS (SELECT batch, max(last) AS longest FROM last GROUP BY batch)
    SELECT batch, slot, t, value FROM rows
    UNION ALL SELECT batch, slot, unnest(range(last + 1, longest + 1)) AS t, -100.0e0 FROM last JOIN size USING (batch)""",
)
def m8(spark, folder):
    members = b.steps(spark, folder).join(batches(spark, folder), "idx").select(
        "batch", "slot", "t", F.col("qty").alias("value")
    )
    members = settle(members, "members")
    padded = sq.pad_rows(
        members, "batch", ["slot"], "t", {"value": F.lit(float(dims.IGNORED_TARGET))}
    )
    return padded


@query(
    "m8_nested_collation",
    """WITH w AS (SELECT conv_id // 8 AS batch, conv_id, turn, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS BIGINT)) AS lens FROM conversations),
    n AS (SELECT *, max(len(lens)) OVER (PARTITION BY batch) AS longest FROM w)
    SELECT batch, conv_id, turn, longest AS padded_to, len(lens) AS words, array_to_string(list_concat(lens, list_transform(range(0, longest - len(lens)), lambda x: 0)), ',') AS lengths FROM n""",
)
def m8_nested(spark, folder):
    rows = b.table(spark, folder, "conversations").select(
        F.floor(F.col("conv_id") / 8).alias("batch"), "conv_id", "turn",
        F.transform(F.split("text", " "), F.length).alias("lens"),
    )
    longest = rows.groupBy("batch").agg(F.max(F.size("lens")).alias("longest"))
    padded = rows.join(longest, "batch").withColumn("p", pad_to(F.col("lens"), F.col("longest"), F.lit(0)))
    return padded.select(
        "batch", "conv_id", "turn", F.size("p").cast("bigint").alias("padded_to"), F.size("lens").cast("bigint").alias("words"),
        F.array_join(F.transform("p", lambda v: v.cast("string")), ",").alias("lengths"),
    )


# two ragged axes: the turns of a conversation and the words of a turn; the longest batch member decides both
RAGGED = """w AS (SELECT conv_id // 8 AS batch, conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS lens FROM conversations),
sizes AS (SELECT batch, max(n) AS turns, max(longest) AS words FROM (SELECT batch, conv_id, count(*) AS n, max(len(lens)) AS longest FROM w GROUP BY ALL) GROUP BY batch),
lists AS (SELECT batch, conv_id, list(lens ORDER BY turn) AS l FROM w GROUP BY ALL)"""


def filled_sql(filler: str) -> str:
    """The nested list ``l`` filled up to (turns, words), as text."""
    words = f"list_concat(coalesce(l[i], []), list_transform(range(0, words - len(coalesce(l[i], []))), lambda x: {filler}))"
    return f"array_to_string(list_transform(range(1, turns + 1), lambda i: array_to_string({words}, ',')), ';')"


def joined(nested):
    """A list of lists as text."""
    return F.array_join(F.transform(nested, lambda r: F.array_join(F.transform(r, lambda v: v.cast("bigint").cast("string")), ",")), ";")


@query(
    "m8_ragged_batches",
    f"""WITH {RAGGED} SELECT batch, conv_id, {filled_sql("0")} AS words, {filled_sql("-100")} AS actions, {filled_sql("-1000000000")} AS logits,
      array_to_string(list_concat(list_transform(l, lambda r: len(r) > 5), list_transform(range(0, turns - len(l)), lambda i: false)), ',') AS mask
    FROM lists JOIN sizes USING (batch)""",
)
def m8_ragged(spark, folder):
    rows = b.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.transform(F.split("text", " "), F.length).alias("lens")
    )
    stacked = nested.stack(rows, ["conv_id"], ["turn"], ["lens"])
    members = stacked.select(
        F.floor(F.col("conv_id") / 8).alias("batch"), "conv_id", F.col("lens").alias("words"), F.col("lens").alias("actions"),
        F.struct(
            F.transform("lens", lambda r: F.transform(r, lambda v: v.cast("double"))).alias("logits"),
            F.transform("lens", lambda r: F.size(r) > 5).alias("mask"),
        ).alias("decoded"),
    )
    fillers = {"actions": dims.IGNORED_TARGET, "decoded.logits": dims.MASKED_LOGIT}
    batches_ = nested.collate(members, "batch", ["words", "actions", "decoded"], fillers)
    return batches_.select(
        "batch", "conv_id", joined("words").alias("words"), joined("actions").alias("actions"),
        joined("decoded.logits").alias("logits"),
        F.array_join(F.transform("decoded.mask", lambda v: v.cast("string")), ",").alias("mask"),
    )


@query(
    "m9_nested_operators",
    f"""WITH {b.STEPS}, a AS (SELECT idx, list(part ORDER BY t) AS parts, list(CAST(qty AS BIGINT) ORDER BY t) AS qtys, list([part, supp] ORDER BY t) AS pairs FROM steps GROUP BY ALL)
    SELECT idx, array_to_string(list_concat(parts, parts[1:1]), ',') AS longer, array_to_string(qtys[2:3], ',') AS middle,
      array_to_string(list_transform(pairs, lambda p: p[1]), ',') || ';' || array_to_string(list_transform(pairs, lambda p: p[2]), ',') AS turned, 1 AS batch_dim FROM a""",
)
def m9_operators(spark, folder):
    steps = b.steps(spark, folder).select(
        "idx", "t", F.struct("part", F.struct(F.col("qty").cast("bigint").alias("qty"), F.array("part", "supp").alias("pair")).alias("in")).alias("item")
    )
    stacked = nested.stack(steps, ["idx"], ["t"], ["item"])
    kind = stacked.schema["item"].dataType
    first = nested.cut(F.col("item"), kind, 0, 1)
    pairs = F.struct(F.col("item.in.pair").alias("pair"))
    pairs_kind = stacked.select(pairs.alias("p")).schema["p"].dataType
    text = lambda column: F.array_join(F.transform(column, lambda v: v.cast("string")), ",")
    return stacked.select(
        "idx",
        text(nested.concat(F.col("item"), first, kind)["part"]).alias("longer"),
        text(nested.cut(F.col("item"), kind, 1, 2)["in"]["qty"]).alias("middle"),
        joined(nested.transpose(pairs, pairs_kind)["pair"]).alias("turned"),
        F.size(nested.add_batch_dim(F.col("item"), kind)["in"]["pair"]).alias("batch_dim"),
    )


@query(
    "m9_stacked_sequences",
    f"""WITH {b.STEPS}, a AS (SELECT idx, list(part ORDER BY t) AS parts, list(qty ORDER BY t) AS qtys FROM steps GROUP BY ALL)
    SELECT idx, len(parts) + 1 AS concatenated, array_to_string(parts[2:3], ',') AS sliced, CAST(list_sum(qtys) AS BIGINT) AS transposed_sum, 1 AS batch_dim FROM a""",
)
def m9(spark, folder):
    sequences = ds.nest(b.steps(spark, folder), ["idx"], ["part", "qty"], "items")
    longer = F.concat("items", F.slice("items", 1, 1))
    by_field = F.struct(F.col("items.part").alias("part"), F.col("items.qty").alias("qty"))
    return sequences.select(
        "idx",
        F.size(longer).cast("bigint").alias("concatenated"),
        F.array_join(F.transform(F.slice(by_field["part"], 2, 2), lambda v: v.cast("string")), ",").alias("sliced"),
        F.aggregate(by_field["qty"], F.lit(0.0), lambda acc, q: acc + q).cast("bigint").alias("transposed_sum"),
        F.size(F.array("items")).alias("batch_dim"),
    )


@query(
    "m10_end_effector_codes",
    f"""WITH {b.STEPS}, {b.INSTANCES} SELECT idx, t, CASE WHEN task = 11 THEN 1 ELSE 0 END AS code FROM steps JOIN instances USING (idx)""",
)
def m10(spark, folder):
    effector = F.when(F.col("task") == 11, "spatula").otherwise("suction")
    codes = b.instances(spark, folder).select("idx", end_effector_code(effector).alias("code"))
    return b.steps(spark, folder).select("idx", "t").join(codes, "idx")
