"""Roles: those of rows by turn stay, those of other layouts get the canonical names."""

from folio.llm import chat


def test_roles_of_rows_by_turn_are_kept(spark):
    given = [(1, 0, "human", "q"), (1, 1, "gpt", "a"), (1, 2, "assistant", "b"), (1, 3, None, None)]
    turns = chat.canonical(spark.createDataFrame(given, "conv_id long, turn long, role string, text string"))
    read = chat.read_back(chat.formatted(turns)).first()
    assert [(t.role, t.text) for t in read.turns] == [("human", "q"), ("gpt", "a"), ("assistant", "b"), ("", "")]
    assert read.loss_text == "b"


def test_roles_of_other_layouts_are_renamed(spark):
    schema = "id long, conversations array<struct<`from`:string,value:string>>"
    turns = chat.canonical(spark.createDataFrame([(2, [("human", "q"), ("gpt", "a")])], schema))
    assert [(r.role, r.text) for r in turns.orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
