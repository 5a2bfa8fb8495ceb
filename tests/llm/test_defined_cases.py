"""Defined cases that the operators share: empty tables, clashing columns, very long texts, and the bound of packing."""

import math

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import chats, gif, html, mixing, ngram_join, packing, quality, runs, tries, warc

DOCUMENTS = {"op1": gif.op1_gif, "op5": mixing.op5_mixing, "op6": quality.op6_quality_rules, "op9": ngram_join.op9_ngram_jaccard, "op10": packing.op10_packing, "op12": runs.op12_periodic_runs}
OTHERS = {
    "op4": (html.op4_html_text, "page_id long, url string, html string", [(1, "http://a.com/x", "<p>one</p><article><p>text</p></article>"), (2, None, None), (2, None, None), (None, "http://a.com/y", "<main>" + "<p>line of text</p>" * 3000 + "</main>")]),
    "op8": (warc.op8_warc, "page_id long, url string, html string", [(1, "u", "x" * 100_000), (2, None, None), (2, None, None), (None, "u", "y")]),
    "op11": (chats.op11_chat_format, "conv_id long, turn long, role string, text string", [(1, 0, "user", "a"), (1, 1, None, None), (None, None, "assistant", "b" * 100_000)]),
    "op13": (tries.op13_prefix_trie, "conv_id long, turn long, role string, text string", [(1, 0, "user", "a"), (2, 0, "user", "a"), (None, None, "assistant", "b"), (3, None, None, "b" * 100_000)]),
}
CASES = {n: (f, "doc_id long, text string, source string", [(1, "a b c " * 30, "s"), (2, None, None), (None, "", "s"), (3, "word " * 30_000, "s"), (3, "word " * 30_000, "s")]) for n, f in DOCUMENTS.items()} | OTHERS


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", CASES)
def test_empty_tables_and_clashing_columns(spark, name):
    run, schema, data = CASES[name]
    table = spark.createDataFrame(data, schema).repartition(2)
    result = run(table)
    want = rows(result)
    clashing = table.withColumns({c: F.lit("clash") for c in result.columns if c not in table.columns})
    assert rows(run(clashing)) == want
    assert run(clashing.limit(0)).count() == (1 if name == "op11" else 0)  # that has a conversation of its own


def test_packing_keeps_the_bound(spark, sf):
    """No fewer sequences are possible than tokens fill, and hardly more are used."""
    packed = packing.op10_packing(spark.read.parquet(f"{sf}/documents.parquet"))
    tokens, sequences = packed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert sequences <= math.ceil(math.ceil(tokens / 2048) * 1.05) + 1
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n > 2048 or n <> end").count() == 0
