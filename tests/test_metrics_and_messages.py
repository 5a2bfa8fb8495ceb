import math

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import conversations as C, metrics as E


def test_tags_and_report(spark):
    gold = spark.createDataFrame([(1, "今日 は 晴れ"), (2, "x")], "line_id long, text string")
    pred = spark.createDataFrame([(1, "今 日は 晴れ"), (2, "xy")], "line_id long, text string")
    assert "".join(r.tag for r in E.bi_tags(gold.where("line_id = 1")).orderBy("char_pos").collect()) == "BIBBI"
    assert [r.line_id for r in E.unequal_lines(gold, pred).collect()] == [2]
    report = {r.label: r for r in E.segmentation_report(E.tag_counts(gold, pred)).collect()}
    # gold BIBBI, predicted BBIBI
    assert report["B"].support == 3 and report["B"].precision == 0.667 and report["I"].recall == 0.5 and report["accuracy"].f1 == 0.6


def test_perplexities(spark):
    lines = spark.createDataFrame([(1, [1, 1, 2]), (2, [0])], "line_id long, ids array<int>")
    vocab = spark.createDataFrame([(0, -5.0), (1, math.log(0.5)), (2, math.log(0.25))], "token_id int, lp double")
    assert E.perplexity_model(lines, vocab, (0,)).first()[0] == pytest.approx(math.exp(-(2 * math.log(0.5) + math.log(0.25)) / 3))
    assert E.perplexity_new_unigram(lines, (0,)).first()[0] == pytest.approx(math.exp(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3))))
    assert E.encoding_stats(lines, {"unk": 0}).first().asDict() == {"n_tokens": 4, "n_kept": 3, "n_unk": 1, "n_types": 3}


MARK = {m: i for i, m in enumerate(("<|start|>", "<|channel|>", "<|constrain|>", "<|message|>", "<|end|>", "<|return|>", "<|call|>"))}
S_, CH, CO, ME, EN, RE, CA = range(7)


def by_hand(ids):
    names, ends = {S_: "role", CH: "channel", CO: "constrain", ME: "content"}, {EN: "END", RE: "END", CA: "CALL"}
    out, parts, section = [], {}, None
    for i, t in enumerate(ids):
        if t in names:
            section = names[t]
            parts[section] = ([], i + 1)
        elif t in ends:
            out.append((ends[t], parts))
            parts, section = {}, None
        elif section:
            parts[section][0].append(t)
    return out + ([("INCOMPLETE", parts)] if section else [])


CASES = [[S_, 10, ME, 11, 12, EN], [S_, 10, CH, 11, CO, 12, ME, 13, CA, 99, EN], [99, EN], [S_, 1 + 9, ME, 20, ME, 21, RE, S_, 30], [], [50, 51], [S_, 10, ME, 11, EN, S_, 12, ME, CA]]


def test_parse_messages(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "conv_id long, token_ids array<int>")
    got = {}
    for r in C.parse_messages(df, MARK).orderBy("conv_id", "msg_no").collect():
        parts = {s: (r[s].token_ids, r[s].start) for s in C.SECTIONS if r[s] is not None}
        got.setdefault(r.conv_id, []).append((r.end, parts))
    assert got == {i: by_hand(c) for i, c in enumerate(CASES) if by_hand(c)}
    back = C.parse_messages_reverse(df.where("conv_id = 6"), MARK).orderBy("reverse_no").collect()
    assert [r.role.token_ids for r in back] == [[12], [10]] and [r.role.start for r in back] == [1, 1]


TURNS = "conv_id long, turn int, role string, text string, thinking string, tool_name string, tool_arguments string"
TALK = [
    (1, 0, "system", "Be kind.", None, None, None),
    (1, 1, "user", "hi", None, None, None),
    (1, 2, "assistant", "look up", None, "search", '{"q": "x"}'),
    (1, 3, "tool", 'a "quote"', None, None, None),
    (1, 4, "assistant", "done", "so", None, None),
    (2, 0, "user", "go", None, None, None),
    (2, 1, "assistant", None, "think", "run", "{}"),
    (3, 0, "tool", "lost", None, None, None),
    (3, 1, "assistant", "<|channel|>final<|message|>", None, None, None),
]


def test_rendering(spark):
    df = spark.createDataFrame(TALK, TURNS)
    rows = {r.conv_id: r.rendered for r in C.render_conversations(df, "[sys]").collect()}
    assert rows[1] == (
        "[sys]<|start|>developer<|message|># Instructions\n\nBe kind.\n\n<|end|><|start|>user<|message|>hi<|end|>"
        '<|start|>assistant to=functions.search<|channel|>commentary json<|message|>{"q": "x"}<|call|>'
        '<|start|>functions.search to=assistant<|channel|>commentary<|message|>"a \\"quote\\""<|end|>'
        "<|start|>assistant<|channel|>analysis<|message|>so<|end|><|start|>assistant<|channel|>final<|message|>done<|return|>"
    )
    assert rows[2].endswith("<|start|>assistant<|channel|>analysis<|message|>think<|end|><|start|>assistant to=functions.run<|channel|>commentary json<|message|>{}<|call|>")
    prompted = {r.conv_id: r.rendered for r in C.render_conversations(df, "", generation_prompt=True).collect()}
    assert prompted[1].endswith("final<|message|>done<|end|><|start|>assistant") and ">so<" not in prompted[1]
    bad = {(r.conv_id, r.turn): r.reason for r in C.invalid_turns(df).collect()}
    assert bad == {(3, 0): "tool turn without a call", (3, 1): "marker in content"}
    fields = C.extract_response_fields(spark.createDataFrame([(rows[1].replace(" to=functions.search<|channel|>commentary json", "<|channel|>commentary to=functions.search json"),)], "text string")).first()
    assert fields.content == "done" and fields.thinking == "so"
    assert fields.tool_calls[0].name == "search" and fields.tool_calls[0].arguments == {"q": "x"}


def test_special_token_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"bos_token": "<s>", "pad_token": {"content": "<pad>", "lstrip": false}}')
    got = {r.kind: r.token for r in C.parsed_special_tokens(spark, str(tmp_path / "m.json"), "g").collect()}
    assert got == {"bos_token": "<s>", "pad_token": "<pad>"}


def test_comparison(spark):
    a = spark.createDataFrame([(1, ["▁a", "b"], [1, 2]), (2, ["▁c"], [3])], "line_id long, pieces array<string>, ids array<int>")
    b = spark.createDataFrame([(1, ["▁a", "b"], [1, 5])], "line_id long, pieces array<string>, ids array<int>")
    texts = spark.createDataFrame([(1, "ab"), (2, "c ")], "line_id long, text string")
    got = {r.line_id: (r.same_pieces, r.same_ids, r.round_trip) for r in E.compare_segmentations(a, b, texts).collect()}
    assert got == {1: (True, False, True), 2: (False, False, False)}
    assert E.chars_per_token(spark.createDataFrame([("en", 10, 4)], "lang string, n_chars int, n_tokens int")).select(F.round("chars_per_token", 2)).first()[0] == 2.5


def test_texts_that_begin_with_a_z_differ(spark, tmp_path, against_duckdb):
    """a cut in front of the first character is none."""
    from lexiforge.plans import queries as Q

    spark.createDataFrame([(0, "zoo"), (1, "ab"), (2, "zz"), (3, "z"), (4, "az"), (5, None), (6, "")], "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    against_duckdb(Q.QUERIES["compare_segmentations"](spark, str(tmp_path)), Q.ORACLES["compare_segmentations"], str(tmp_path))


def test_message_parsers_make_no_row_of_an_id(spark, sf):
    """neither parser explodes token ids or deals them out again."""
    from lexiforge.plans import queries as Q

    for name in ("parse_messages", "parse_messages_reverse"):
        plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") == 1 and "Window" not in plan and "Join" not in plan
