import json

from pyspark.sql import functions as F

from lexiforge.sources import corpus, vocab_files


def test_jsonl_and_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"text": t}, ensure_ascii=False) for t in ("一行目\n二行目", "x")))
    rows = corpus.read_jsonl_text(spark, str(tmp_path / "a.jsonl")).collect()
    assert [r.text for r in rows] == ["一行目", "二行目", "", "x", ""]
    (tmp_path / "t.txt").write_text("a  \n b\n\nc")
    lines = corpus.read_lines(spark, str(tmp_path / "t.txt"))
    assert [tuple(r) for r in lines.orderBy("line_id").collect()] == [(0, "a"), (1, " b"), (2, ""), (3, "c")]
    (tmp_path / "ids").write_text("3\n0\n3\n")
    kept = corpus.extract_lines(lines, corpus.read_line_ids(spark, str(tmp_path / "ids")))
    assert sorted(r.line_id for r in kept.collect()) == [0, 3]


def test_vocab_files(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("<unk>\t0.0\n\n\t-1.5\n▁a\t-2.0\n")
    rows = vocab_files.read_vocab(spark, str(tmp_path / "v.tsv")).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(0, "<unk>", 0.0), (1, "\n", -1.5), (2, "▁a", -2.0)]
    v = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.0), (2, "c", 0.25)], "pos int, token string, theta double")
    vocab_files.write_vocab(v, str(tmp_path / "o"), "log2")
    assert [tuple(r)[1:] for r in vocab_files.read_vocab(spark, str(tmp_path / "o")).orderBy("pos").collect()] == [("a", -1.0), ("c", -2.0)]
    (tmp_path / "v.json").write_text('{"東京": 12, "京": 3}')
    assert [tuple(r) for r in vocab_files.read_vocab_json(spark, str(tmp_path / "v.json")).collect()] == [(0, "東京", 12.0), (1, "京", 3.0)]


def test_freq_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("a", 3), ('"\n', 4)], "token string, freq long")
    corpus.write_freq(f, str(tmp_path / "f"))
    assert sorted(map(tuple, corpus.read_freq(spark, str(tmp_path / "f")).collect())) == [('"\n', 4), ("a", 3)]


def test_sample_fits_its_budget_and_ignores_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).cast("string")).alias("source"), F.repeat(F.lit("x"), (F.col("id") % 17).cast("int")).alias("text"))
    one = sorted(r.doc_id for r in corpus.sample_corpus(df.repartition(1), 300, buckets=8).collect())
    many = corpus.sample_corpus(df.repartition(7), 300, buckets=8)
    assert one == sorted(r.doc_id for r in many.collect())
    for r in many.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect():
        assert 300 - 17 < r.n <= 300
