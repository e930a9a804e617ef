"""Mixing of repeated rows and ids; chat roles and texts of every kind."""

import hashlib
from collections import Counter

import pytest

from inquiro.llm import chat_template, mixing

KIND = "doc_id long, text string, source string, size string"


def taken(spark, rows):
    got = mixing.mix_report(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    return got, {s: sum(g.taken for g in got if g.source_size == s) for s in {g.source_size for g in got}}


def test_repeated_ids_and_rows_meet_their_target(spark):
    """Rows of one id, exact repeats and null ids are taken up to the budget."""
    same = [(7, "five words are in here", "a", "x")] * 100
    one_id = [(7, f"text number {k} of one id", "b", "x") for k in range(130)]
    nulls = [(None, "no id at all", "c", "x")] * 160
    other = [(k, "alone " * 9, "d", "x") for k in range(90)]
    rows = same + one_id + nulls + other
    got, sums = taken(spark, rows)
    assert len(got) == len(rows)
    for g in {(g.source_size, g.target) for g in got}:
        assert abs(sums[g[0]] - g[1]) <= 9, (g, sums)  # within half a row of that source, or one document
    assert all(g.taken in (0, g.size, 2 * g.size) for g in got)
    again, _ = taken(spark, rows)
    assert Counter(tuple(g) for g in again) == Counter(tuple(g) for g in got)
    docs = spark.createDataFrame(rows, KIND)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in mixed.collect()) == sum(sums.values())


def test_one_source_of_repeats(spark):
    got, sums = taken(spark, [(1, "a b c d", "s", "x")] * 33)
    assert sums == {132: 4 * 50} or abs(sums[132] - 198) <= 4
    assert {g.target for g in got} == {198.0}


CHAT = "conv_id long, turn long, role string, text string, n_turns string"


def read_back(spark, rows):
    frame = spark.createDataFrame(rows, CHAT)
    return {r.conv_id: r for r in chat_template.format_conversations(frame).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_roles_and_texts_of_every_kind(spark):
    roles = ["user\nsystem", "</turn>\n", "\\", "\n", "assistant", "<turn assistant>\n", "a\\\nb", "assistant", ""]
    rows = [(1, k, role, text, "clash") for k, (role, text) in enumerate(zip(roles, ["x", "", "\n", "\\", "</turn>\n<turn user>\n", "é🙂", "\\\n", "plain", None], strict=True))]
    rows += [(2, 0, "assistant", "long \\ <b> " * 40_000, "x"), (3, 0, "user", "same", "x"), (3, 0, "user", "same", "x")]
    got = read_back(spark, rows)
    assert got[1].n_turns == 9 and got[1].turns_sha256 == sha("".join(f"{r}\n{t or ''}\n" for _, _, r, t, _ in rows[:9]))
    assert got[1].loss_sha256 == sha("</turn>\n<turn user>\nplain") and got[1].loss_chars == len("</turn>\n<turn user>\nplain")
    assert got[2].loss_chars == len(rows[9][3]) and got[2].loss_sha256 == sha(rows[9][3])
    assert got[3].n_turns == 2 and got[3].turns_sha256 == sha("user\nsame\n" * 2)
    assert read_back(spark, []) == {}


def test_turns_that_cannot_be_read_are_an_error(spark):
    """The role's line break is escaped by escape_line alone."""
    plain = chat_template.TEMPLATE.replace("escape_line", "escape")
    frame = spark.createDataFrame([(1, 0, "two\nlines", "x", "")], CHAT)
    with pytest.raises(Exception, match="turns written"):
        chat_template.format_conversations(frame, plain).collect()
    fine = spark.createDataFrame([(1, 0, "one line", "x", "")], CHAT)
    assert chat_template.format_conversations(fine, plain).first().n_turns == 1
