"""Mixing sources to target weights, cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import col, fresh, running_totals, same, text_key
from corpusmill.session import materialize

#: A source's target stops at this many times its size.
MOST_EPOCHS = 3
#: Weights by place of the source in code point order, repeating.
WEIGHTS = (1, 2, 3)

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row per source.

    The sum of all sizes is shared by weight; a target stops at ``most`` times
    its source's size and the excess is shared again by weight. Sources fill up
    in order of size / weight, so the sources that stop are the first in that
    order and the share of the rest follows from two running sums.
    """
    placed = running_totals(sizes.withColumn("one", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()], {"one": "place"}, "mix-places")
    weight = F.lit(list(weights))[(F.col("place") % len(weights)).cast("int")].cast("long")
    caps = placed.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = materialize(running_totals(caps, [], [F.col("ratio").asc(), F.col("source").asc_nulls_last()], {"cap": "cap_before", "weight": "weight_before"}, "mix-caps"), "mix-filled")
    whole = filled.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    total, all_weights = whole["total"] or 0, whole["weights"] or 0
    level = (F.lit(total) - F.col("cap_before")) / (F.lit(all_weights) - F.col("weight_before"))
    found = filled.select(level.alias("level"), "ratio").where(F.col("level") <= F.col("ratio")).agg(F.max("level").alias("level")).first()["level"]
    share = F.lit(float("inf") if found is None else float(found)) * F.col("weight")
    return filled.select("source", "source_size", F.least(share, F.col("cap").cast("double")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 17) -> DataFrame:
    """(doc_id, tk, size, source, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    A source is read in whole epochs as often as its target allows; of the next
    epoch the documents come in hash-random order of (seed, doc_id) until the
    budget is used to the word: the document in which it ends is taken in part.
    taken counts words over all epochs. A null text has size 0 and takes
    nothing; null sources are one source, the last. Null doc_ids take part.
    Repeated rows are rows of their own and share the order's place by chance.
    A source of size 0 has target 0. An empty table gives no rows.
    """
    rows = docs.select(
        col("doc_id").cast("long").alias("doc_id"), text_key(col("text")).alias("tk"), col("source").cast("string").alias("source"), word_count(col("text")).alias("size")
    ).withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    order = [F.col("draw").asc(), F.col("doc_id").asc_nulls_first(), F.col("tk").asc(), F.col("size").asc()]
    placed = materialize(running_totals(rows, ["source"], order, {"size": "before"}, "mix-ranges"), "mix-placed")
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = targets.select(F.col("source").alias("s"), "source_size", "target")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    joined = placed.join(targets, same(F.col("source"), F.col("s")))
    return joined.select("doc_id", "tk", "size", "source", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 17) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a document once per epoch that takes it whole, and once cut to its first words where the budget ends.

    Documents without a word stay once: they take nothing from a budget.
    n_chars, where present, follows the cut text. Other columns stay.
    """
    key, text, source, copy, no = (fresh(docs, n) for n in ("_k_id", "_k_text", "_k_source", "_k_copy", "_k_no"))
    # wholly repeated rows can't be told apart: together they have at most three different decisions, handed out in any order
    plan = mixed(docs, weights, most, seed).groupBy("doc_id", "tk", "source", "size", "taken").agg(F.count(F.lit(1)).alias("n"))
    plan = plan.groupBy("doc_id", "tk", "source", "size").agg(F.sort_array(F.collect_list(F.struct("taken", "n")), asc=False).alias("_decided"))
    plan = plan.select(F.col("doc_id").alias("_p_id"), F.col("tk").alias("_p_tk"), F.col("source").alias("_p_source"), F.col("size").alias("_p_size"), "_decided")
    plan = plan.select(F.struct("*").alias(fresh(docs, "_plan")))
    p = F.col(fresh(docs, "_plan"))
    rows = docs.select("*", col("doc_id").cast("long").alias(key), text_key(col("text")).alias(text), col("source").cast("string").alias(source))
    joined = rows.join(plan, same(F.col(key), p["_p_id"]) & same(F.col(text), p["_p_tk"]) & same(F.col(source), p["_p_source"]))
    joined = joined.withColumn(no, F.row_number().over(Window.partitionBy(key, text, source).orderBy(key)))
    none = F.lit(None).cast("long")
    pick = F.aggregate(
        p["_decided"],
        F.struct(F.lit(0).cast("long").alias("seen"), none.alias("taken")),
        lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["taken"], F.when(a["seen"] + x["n"] >= F.col(no), x["taken"])).alias("taken")),
        lambda a: a["taken"],
    )
    size = p["_p_size"]
    whole = F.when(size > 0, F.floor(pick / size)).otherwise(1).cast("int")
    rest = F.when(size > 0, pick % size).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = joined.withColumn(copy, F.explode(copies))
    words = F.regexp_extract_all(col("text"), F.lit(rf"[\x20\x09-\x0D]*{_WORD}"), F.lit(0))
    cut = F.when(F.col(copy) < 0, col("text")).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.col(copy), F.lit(1))), ""))
    out = out.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(copy) < 0, col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[col(c) for c in docs.columns])
