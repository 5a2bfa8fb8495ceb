import random

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiforge.functions import text as X
from lexiforge.functions.patterns import RUN_SYMBOLS, SYMBOLS

LET = r"\p{Script=Hiragana}\p{Script=Katakana}ー\p{Script=Han}〇一二三四五六七八九a-zA-Z "


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", f(F.col("t"))).orderBy("i").collect()]


def symbols_by_hand(line):
    is_let = lambda c: regex.match(f"[{LET}]", c) is not None
    line = line.rstrip()[:1000]
    out = ""
    for c in line:
        out += " " + c if out and out[-1] != " " and not is_let(c) else c
    done = ""
    for c in out:
        done += " " + c if done and not is_let(done[-1]) and c != " " else c
    return done


def test_split_symbols(spark):
    rng = random.Random(1)
    lines = ["sorry!!!「」12", "", "  a  b ", "éü\tx", "a1b2", "x" * 1500 + "!"] + ["".join(rng.choice("aあ漢!1 é「") for _ in range(12)) for _ in range(200)]
    assert column(spark, lines, X.split_symbols)[0] == "sorry ! ! ! 「 」 1 2"
    assert column(spark, lines, X.split_symbols) == [symbols_by_hand(x) for x in lines]


def test_split_symbol_runs(spark):
    rng = random.Random(2)
    lines = ["a!!b", "\\!!", "「「」", ""] + ["".join(rng.choice("a!「\\].-") for _ in range(10)) for _ in range(100)]

    def by_hand(s):
        out = ""
        for c in s.strip():
            out += " " + c if out and out[-1] in RUN_SYMBOLS and c in RUN_SYMBOLS else c
        return out

    assert column(spark, lines, X.split_symbol_runs) == [by_hand(x) for x in lines]


def test_predicates(spark):
    values = ["東京", "abc", "a b", "ー", "!", "\\", "é", ""]
    assert column(spark, values, X.has_script) == [True, False, True, True, False, False, False, False]
    assert column(spark, values, X.has_symbol) == [any(c in SYMBOLS for c in v) for v in values]


def test_sentences_digits_and_heads(spark):
    assert column(spark, ["今日。明日。", "a", ""], X.split_sentences) == [["今日。", "明日。"], ["a"], []]
    assert column(spark, ["a12b", "3", "x 4"], X.split_digits) == ["a 1 2 b", "3", "x 4"]
    assert column(spark, ["a b"], X.normalize_for_model) == ["▁a▁b"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé漢😀 b", max_size=8), min_size=1, max_size=10))
def test_bytes_round_trip(spark, values):
    pieces = lambda t: X.byte_fallback(F.concat(F.array(F.lit("▁")), X.chars(F.translate(t, " ", "▁"))), F.concat(F.array(F.lit(True)), F.transform(X.chars(t), lambda c: c.rlike("[ab ]"))))
    assert column(spark, values, lambda t: X.decode_pieces(pieces(t))) == values


def test_eod(spark):
    row = spark.range(1).select(X.add_eod(F.array(F.lit(1), F.lit(2)), 9).alias("a"), X.add_eod(F.array(F.lit(1)), 9, F.array(F.lit(2), F.lit(3))).alias("b"), X.type_ids(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3))).alias("t")).first()
    assert (row.a, row.b, row.t) == ([1, 2, 9], [1, 9, 2, 3, 9], [0, 0, 1, 1, 1])


@pytest.mark.parametrize("n", [0, 3, 10])
def test_truncate(spark, n):
    assert column(spark, ["abcdef"], lambda t: X.truncate_lines(t, n)) == ["abcdef"[:n]]


def test_bounded_classes_are_the_same_classes(spark):
    """most characters are decided by a bound, without a look at the whole class."""
    from lexiforge.functions import text as X
    from lexiforge.functions.patterns import SCRIPT, SYMBOLS, char_class

    assert X.SCRIPT_PATTERN != f"[{SCRIPT}]"
    c = spark.range(1, 0x30000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    both = c.where((X.has_script(F.col("c")) != F.col("c").rlike(f"[{SCRIPT}]")) | (X.has_symbol(F.col("c")) != F.col("c").rlike(char_class(SYMBOLS))))
    assert both.count() == 0
