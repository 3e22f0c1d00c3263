"""Conversations from messages that quote each other. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import col, running_totals, same
from corpusmill.session import materialize

#: A quoted passage of fewer words is looked for within its own thread only: stock phrases are everywhere.
LEAST_WORDS_ANYWHERE = 5

_MARKS = r"^(?:[ \t]*>)+"
# "On Monday, Ann wrote:", directly before a quotation
_SAID = r"^\s*On .{1,200} wrote:\s*$"


def _normal(text: Column) -> Column:
    """Case and white space do not tell passages apart."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once: an expression inside a lambda would be worked out for each element."""
    return df.withColumn(name, F.explode(F.array(value)))


def _parse(rows: DataFrame) -> DataFrame:
    """Adds own (text without quotations) and runs: (level, lines) of consecutive lines of one quote level.

    Lines that announce a quotation are left out. Works on arrays by position, so the time is linear in the length of a text.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), r"\r\n|\n|\r")
    parsed = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS + " ?", "").alias("line")))
    once = _once(rows, "parsed", parsed)
    p = F.col("parsed")

    def announces(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(p, i + 1)["level"] > x["level"], F.lit(False)) & F.rlike(x["line"], F.lit(_SAID))

    once = _once(once, "kept", F.filter(p, lambda x, i: ~announces(x, i))).drop("parsed")
    k = F.col("kept")
    starts = F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda i: (i == 0) | (F.get(k, i)["level"] != F.get(k, i - 1)["level"]))
    once = _once(once, "starts", F.when(F.size(k) > 0, starts).otherwise(F.array().cast("array<int>")))
    s = F.col("starts")
    runs = F.transform(
        s,
        lambda b, i: F.struct(F.get(k, b)["level"].alias("level"), F.transform(F.slice(k, b + 1, F.coalesce(F.get(s, i + 1), F.size(k)) - b), lambda x: x["line"]).alias("lines")),
    )
    own = F.regexp_replace(F.array_join(F.transform(F.filter(k, lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return _once(once, "runs", runs).withColumn("own", own).drop("kept", "starts", "text")


def _units(runs: Column, quoted: bool) -> Column:
    """What is hashed: whole passages (kind 0) and, where there are several, their lines (kind 1)."""
    wanted = F.filter(runs, lambda r: (r["level"] > 0) if quoted else (r["level"] == 0))

    def of(r: Column) -> Column:
        whole = _normal(F.array_join(r["lines"], " "))
        units = F.concat(
            F.array(F.struct(r["level"].alias("level"), F.lit(0).alias("kind"), whole.alias("unit"))),
            F.when(F.size(r["lines"]) > 1, F.transform(r["lines"], lambda x: F.struct(r["level"].alias("level"), F.lit(1).alias("kind"), _normal(x).alias("unit")))).otherwise(
                F.array().cast("array<struct<level:int,kind:int,unit:string>>")
            ),
        )
        return units

    return F.filter(F.flatten(F.transform(wanted, of)), lambda u: u["unit"] != "")


def linked(messages: DataFrame) -> DataFrame:
    """Reply-ordered conversations of ``messages`` (message_id, thread, sent, text).

    Columns: message_id, thread, sent, text (without quotations), parent_id,
    linked (quoted passages whose original was found), root_id, depth (replies
    from the root) and position (from 1, in order of sent and message_id within
    the root's conversation: a parent comes before its replies).

    The original of a passage is the first earlier message that wrote it
    itself: in the same thread, or anywhere for passages of
    LEAST_WORDS_ANYWHERE words or more. The parent is the original of the
    least deeply quoted passages; of several the one that gave whole passages,
    then most characters, then the latest. A null or empty text quotes nothing
    and nobody; a null thread is no thread; a null sent is never earlier or
    later. Wholly repeated messages are one; a message_id that repeats with
    other content is a message of its own. An empty table gives no rows.
    """
    rows = messages.select(
        col("message_id").cast("string").alias("message_id"), col("thread").cast("string").alias("thread"), col("sent").cast("long").alias("sent"), col("text").cast("string").alias("text")
    )
    marked = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in (F.col("message_id"), F.col("thread"), F.col("sent"), F.col("text"))]
    rows = rows.withColumn("nid", F.md5(F.concat(*marked))).dropDuplicates(["nid"])
    parsed = _parse(rows)
    hashed = materialize(
        parsed.select(
            "nid", "message_id", "thread", "sent", "own",
            F.transform(_units(F.col("runs"), False), lambda u: _hash(u["unit"])).alias("wrote"),
            F.transform(
                _units(F.col("runs"), True),
                lambda u: F.struct(u["level"].alias("level"), u["kind"].alias("kind"), F.length(u["unit"]).alias("chars"), F.size(F.split(u["unit"], " ")).alias("words"), _hash(u["unit"]).alias("h")),
            ).alias("quoted"),
        ),
        "quotes-parsed",
    )
    wrote = hashed.where("sent IS NOT NULL").select(F.explode(F.array_distinct("wrote")).alias("h"), "thread", F.struct("sent", "message_id", "nid").alias("o"))
    by_thread = wrote.groupBy("thread", "h").agg(F.min("o").alias("o"))
    anywhere = by_thread.groupBy("h").agg(F.min("o").alias("any_o")).withColumnRenamed("h", "any_h")
    in_thread = by_thread.where("thread IS NOT NULL").select(F.col("thread").alias("t"), F.col("h").alias("th"), F.col("o").alias("thread_o"))
    quoted = hashed.where("sent IS NOT NULL").select("nid", "thread", "sent", F.explode("quoted").alias("q")).select("nid", "thread", "sent", "q.*")
    near = quoted.join(in_thread, (F.col("thread") == F.col("t")) & (F.col("h") == F.col("th")), "left").withColumn("thread_o", F.when(F.col("thread_o.sent") < F.col("sent"), F.col("thread_o"))).drop("t", "th")
    far = near.join(anywhere, F.col("h") == F.col("any_h"), "left")
    found = F.coalesce(F.col("thread_o"), F.when((F.col("words") >= LEAST_WORDS_ANYWHERE) & (F.col("any_o.sent") < F.col("sent")), F.col("any_o")))
    matches = far.withColumn("o", found).where("o IS NOT NULL")
    by_origin = matches.groupBy("nid", "level", "kind", "o").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    choice = F.struct((-F.col("level")).alias("l"), (-F.col("kind")).alias("k"), "chars", F.col("o.sent").alias("s"), F.col("o.message_id").alias("m"), F.col("o.nid").alias("p"))
    parents = by_origin.groupBy("nid").agg(F.max(choice).alias("c"), F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("linked"))
    parents = parents.select(F.col("nid").alias("child"), F.col("c.p").alias("parent"), F.col("c.m").alias("parent_id"), "linked")
    # texts rest while the tree is built and ordered
    tree = materialize(hashed.select("nid", "message_id", "thread", "sent").join(parents, F.col("nid") == F.col("child"), "left").drop("child"), "quotes-tree")
    rooted = _roots(tree.select("nid", "parent")).withColumnRenamed("nid", "node")
    names = tree.select(F.col("nid").alias("root"), F.col("message_id").alias("root_id"))
    out = tree.join(rooted, F.col("nid") == F.col("node")).drop("node", "parent").join(names, "root")
    order = [F.col("sent").asc_nulls_first(), F.col("message_id").asc_nulls_first(), F.col("nid")]
    placed = running_totals(out.withColumn("one", F.lit(1).cast("long")), ["root"], order, {"one": "before"}, "quotes-order")
    texts = hashed.select(F.col("nid").alias("text_of"), F.col("own").alias("text"))
    return placed.join(texts, F.col("nid") == F.col("text_of")).select(
        "message_id", "thread", "sent", "text", "parent_id", F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "root_id", F.col("depth").cast("long").alias("depth"), (F.col("before") + 1).alias("position")
    )


def _roots(tree: DataFrame) -> DataFrame:
    """(nid, root, depth) by pointer doubling: each turn doubles the distance that is known, rows that have reached a root rest.

    Parents are strictly earlier than their replies, so there are no circles.
    """
    done = tree.where("parent IS NULL").select("nid", F.col("nid").alias("root"), F.lit(0).alias("depth"))
    done = materialize(done, "quotes-roots")
    hops = materialize(tree.where("parent IS NOT NULL").select("nid", F.col("parent").alias("up"), F.lit(1).alias("d")), "quotes-hops")
    while hops.limit(1).count():
        ends = done.select(F.col("nid").alias("e"), "root", "depth")
        mids = hops.select(F.col("nid").alias("m"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        step = hops.join(ends, F.col("up") == F.col("e"), "left").join(mids, F.col("up") == F.col("m"), "left")
        step = materialize(step.select("nid", "root", (F.col("d") + F.col("depth")).alias("depth"), "up2", (F.col("d") + F.col("d2")).alias("d2")), "quotes-step")
        done = done.unionByName(step.where("root IS NOT NULL").select("nid", "root", "depth"))
        hops = step.where("root IS NULL").select("nid", F.col("up2").alias("up"), F.col("d2").alias("d"))
    return done


def quoting(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, text) as mail: each message quotes the turn before it, and that one's quotation one level deeper.

    Where (conv_id, turn) repeats, the least text is the one quoted.
    """
    said = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before = {n: said.select(F.col("conv_id").alias(f"c{n}"), (F.col("turn") + n).alias(f"t{n}"), F.col("said").alias(f"s{n}")) for n in (1, 2)}
    rows = turns.select("conv_id", "turn", "text")
    for n in (1, 2):
        rows = rows.join(before[n], same(F.col("conv_id"), F.col(f"c{n}")) & same(F.col("turn"), F.col(f"t{n}")), "left").drop(f"c{n}", f"t{n}")

    def cited(text: Column, mark: str) -> Column:
        return F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)))

    both = F.when(F.col("s1").isNotNull() & F.col("s2").isNotNull(), cited(F.col("s2"), ">> "))
    body = F.concat_ws("\n", both, cited(F.col("s1"), "> "), F.when(F.col("s1").isNotNull(), F.lit("")), F.coalesce("text", F.lit("")))
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.col("conv_id").alias("thread"), F.col("turn").alias("sent"), body.alias("text"))
