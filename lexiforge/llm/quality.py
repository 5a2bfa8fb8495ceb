"""Quality rules: a threshold table compiled into one projection of built-in functions.

``measure`` makes the counts, ``verdicts`` turns a table of :class:`Rule` rows into columns, and
``quality_rules`` does both. No user function and no shuffle is involved; the plan is scan and project.

Defined cases: a null or blank text has no words and fails the base rule; repeated rows are judged
row by row; columns of the input that clash with a result column are replaced by it; texts of any length are judged whole;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import WHITE, let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it on with as was be at by this from are or an",
    "und der die das von zu mit den ist nicht ein eine dem des auf für sich als auch",
    "la le les de et un une du en que est pour qui dans par sur pas",
    "el los las y por con una para del se lo no",
)
STOPS = sorted({w for line in STOP_WORDS for w in line.split()})


@dataclass(frozen=True)
class Rule:
    """A text is rejected when ``part`` is not within [low, high] hundredths of ``whole``.

    ``part`` and ``whole`` name counts of :func:`measure`; a bound of None is not tested, and a rule
    whose ``whole`` is zero holds. Only whole numbers are compared, so no rounding decides a verdict.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 3, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)
MIN_WORDS, MAX_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines", "n_stop_words", "n_repeat_words")


def repeated_words(tokens: Column) -> Column:
    """How many words lie in a three-word window that the array holds twice or more."""
    n = F.size(tokens)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)))

    def twice(ordered: Column) -> Column:
        same = lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(ordered, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def count(h: Column) -> Column:
        windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(F.sort_array(windows), twice), covered))

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, count))


def measure(df: DataFrame, text: str = "text", stops: list[str] = STOPS) -> DataFrame:
    """Adds the counts named in :data:`COUNTS` (all long), from the whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    stop = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stops)
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, stop)).alias("stops"), repeated_words(w).alias("repeats")),
    )
    full = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    of_lines = let(
        F.filter(F.split(whole, "\n"), full),
        lambda x: F.struct(
            F.size(x).alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
            F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("ellipsis"),
            F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("bullet"),
        ),
    )
    bare = F.translate(whole, "#*$%&|<>", "")
    out = df.select(
        *[c for c in df.columns if c not in (*COUNTS, "_w", "_l")],
        of_words.alias("_w"),
        of_lines.alias("_l"),
        F.length(F.regexp_replace(whole, WHITE, "")).alias("_c"),
        (F.length(whole) - F.length(bare)).alias("_s"),
    )
    values = ("_w.n", "_c", "_s", "_l.n", "_l.dup", "_l.ellipsis", "_l.bullet", "_w.stops", "_w.repeats")
    return out.withColumns({k: F.col(v).cast("long") for k, v in zip(COUNTS, values, strict=True)}).drop("_w", "_l", "_c", "_s")


def verdicts(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """The columns that a threshold table compiles into: base_failed, failed_rules and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    fails = []
    for r in rules:
        part, whole = 100 * F.col(r.part), F.col(r.whole)
        low = F.lit(False) if r.low is None else part < r.low * whole
        high = F.lit(False) if r.high is None else part > r.high * whole
        fails.append((r.name, (whole > 0) & (low | high)))
    failed = F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in fails])
    passes = F.lit(True)
    for _, test in fails:
        passes = passes & ~test
    return {"base_failed": base, "failed_rules": failed, "kept": ~base & passes}


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the counts, base_failed, failed_rules (comma-separated names) and kept."""
    return measure(df, text).withColumns(verdicts(rules))


def op6_quality_rules(docs: DataFrame) -> DataFrame:
    out = quality_rules(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "failed_rules")


def oracle() -> str:
    """DuckDB SQL for :func:`op6_quality_rules`."""
    stops = ", ".join(f"'{w}'" for w in STOPS)
    white = r"[\x20\x09-\x0D]"
    tests = []
    for r in RULES:
        bounds = [f"100 * {r.part} < {r.low} * {r.whole}"] * (r.low is not None) + [f"100 * {r.part} > {r.high} * {r.whole}"] * (r.high is not None)
        tests.append((r.name, f"({r.whole} > 0 AND ({' OR '.join(bounds)}))"))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '{white}+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
c AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM c, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{white}+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…){white}*$'))) AS BIGINT) AS n_ellipsis_lines,
        CAST(len(list_filter(l, lambda x: regexp_matches(x, '^{white}*[-*•]'))) AS BIGINT) AS n_bullet_lines,
        CAST(len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stops}))) AS BIGINT) AS n_stop_words,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM s LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(t for _, t in tests)}) AS kept, n_stop_words,
  concat_ws(',', {', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests)}) AS failed_rules FROM b"""
