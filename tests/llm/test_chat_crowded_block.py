"""A block of very many turns: null and repeated numbers."""

from test_chat_perspectives import brute, rows_of

from wingspan.llm import chat_perspectives as C


def test_crowded_blocks(spark):
    rows = [(None, i % 3, f"r{i % 2}", f"t{i % 701}") for i in range(6000)] + [(1, None, f"speaker{i % 3}", "x" * (i % 50)) for i in range(6000)]
    df = C.views(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert rows_of(df) == brute(rows, 512)
    assert df.filter("n_turns > 512").isEmpty()


def test_offsets_are_not_folded(spark):
    """A fold that appends to an array for each turn takes time that grows with the square of a block."""
    turns = spark.createDataFrame([(1, 0, "ann", "hi")], "conv_id long, turn long, role string, text string")
    assert " aggregate(" not in C.views(turns)._jdf.queryExecution().optimizedPlan().toString()
