import pytest

import __spark_entry__ as entry
from lexiforge import queries as core

#: A few queries of each area; the driver compares all of them.
NAMES = ["extract_lines", "split_symbols", "count_ngrams", "merge_vocabs", "shrink_vocab_by_total", "token_char_ids", "segment_words", "chars_per_token", "segmentation_report", "parse_messages", "render_conversations"]


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, sf, against_duckdb, name):
    against_duckdb(core.queries()[name](spark, sf), core.oracle_sql()[name], sf)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(core.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_streaming_counts(spark, sf, tmp_path):
    from lexiforge.streaming.counts import read_document_stream, streaming_ngrams

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming_ngrams(read_document_stream(spark, str(tmp_path / "in"), docs.schema, 1), 2)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("grams").start()
    q.processAllAvailable()
    q.stop()
    from lexiforge.operators.ngrams import count_ngrams, to_segments

    want = count_ngrams(to_segments(docs), 2)
    assert spark.table("grams").exceptAll(want).count() == 0 and spark.table("grams").count() == want.count()
