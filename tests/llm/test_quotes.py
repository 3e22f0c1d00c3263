"""Quotation links on messages written by hand."""

from __future__ import annotations

from corpusmill.llm import quotes

COLUMNS = "message_id string, thread string, sent long, text string"


def by_id(spark, rows):
    found = quotes.linked(spark.createDataFrame(rows, COLUMNS)).collect()
    return {r["message_id"]: r for r in found}, found


def test_nested_quotes_and_orders(spark):
    rows = [
        ("a", "t", 1, "First question about the\nnew index layout."),
        ("b", "t", 2, "On Monday, Ann wrote:\n> First question about the\n> new index layout.\n\nAn answer  to it."),
        ("c", "t", 3, ">> First question about the\n>> new index layout.\n> an answer to   IT.\nThanks!"),
        ("d", "t", 4, "> new index layout.\nOnly one line is quoted."),
        ("e", "t", 5, "> nobody ever wrote this\nStill text."),
        ("f", "t", 6, "> > > First question about the\n>>> new index layout.\ndeep only"),
        ("g", "u", 7, "> an answer to it.\nshort phrase of another thread"),
        ("h", "u", 8, "> First question about the new index layout.\nlong passage of another thread, wrapped anew"),
        ("i", "t", 0, "> An answer to it.\nsent before what it quotes"),
    ]
    got, found = by_id(spark, rows)
    assert len(found) == len(rows)
    assert {m: r["parent_id"] for m, r in got.items()} == {"a": None, "b": "a", "c": "b", "d": "a", "e": None, "f": "a", "g": None, "h": "a", "i": None}
    assert {m: r["root_id"] for m, r in got.items()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "a", "g": "g", "h": "a", "i": "i"}
    assert {m: r["depth"] for m, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 0, "f": 1, "g": 0, "h": 1, "i": 0}
    assert [m for _, m in sorted((r["position"], m) for m, r in got.items() if r["root_id"] == "a")] == ["a", "b", "c", "d", "f", "h"]
    assert got["b"]["text"] == "An answer  to it." and got["c"]["text"] == "Thanks!" and got["a"]["text"] == "First question about the\nnew index layout."
    assert got["c"]["linked"] == 2 and got["d"]["linked"] == 1 and got["e"]["linked"] == 0


def test_the_first_writer_in_the_thread_is_the_original(spark):
    rows = [("a1", "t", 1, "the same words are written twice"), ("a0", "s", 0, "the same words are written twice"), ("a2", "t", 2, "The same words are written twice"), ("r", "t", 3, "> the same words are written twice\nreply"), ("x", "w", 9, "> the same words are written twice\nelsewhere"), ("n", None, 9, "> the same words are written twice\nno thread")]
    got, _ = by_id(spark, rows)
    assert {m: got[m]["parent_id"] for m in ("r", "x", "n")} == {"r": "a1", "x": "a0", "n": "a0"}


def test_long_chains_and_a_hot_thread(spark):
    rows = [(f"m{i}", "t", i, f"> own words number {i - 1}\nown words number {i}") for i in range(90)]
    got, _ = by_id(spark, rows)
    assert [got[f"m{i}"]["depth"] for i in range(90)] == list(range(90))
    assert [got[f"m{i}"]["position"] for i in range(90)] == list(range(1, 91))


def test_edge_rows(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [("a", "t", 1, None), ("b", "t", 2, ""), ("c", "t", 3, ">\n> \n"), ("d", "t", None, "> x y z\nw"), (None, None, None, None), ("e", "t", 5, long), ("f", "t", 6, "> " + long.replace("\n", "\n> ") + "\nyes"), ("g", "t", 7, "q"), ("g", "t", 7, "q"), ("g", "t", 7, "other")]
    got, found = by_id(spark, rows)
    assert len(found) == len(rows) - 1  # wholly repeated messages are one
    assert got["f"]["parent_id"] == "e" and got["f"]["text"] == "yes" and got["c"]["text"] == ""
    assert sum(r["message_id"] == "g" for r in found) == 2
    assert quotes.linked(spark.createDataFrame([], COLUMNS)).count() == 0
    assert quotes.quoting(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0
