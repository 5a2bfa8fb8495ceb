"""One query per operator over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as X
from lexiforge.functions.patterns import HEAD, RUN_SYMBOLS, SYMBOLS, UNK
from lexiforge.operators import conversations as C, lattice as L, levels as K, lines as W, metrics as E, nbest as B, ngrams as N, segment as S, train as M, vocab as V
from lexiforge.operators.trie import matcher
from lexiforge.plans import recipes
from lexiforge.plans.base import EDGES, LN_EDGES, MARKERS, MAX_LENGTH, MIN_FREQ, NG, PATHS, SEEDS, SEG, SUB, VOC, WORDS
from lexiforge.plans.base import edges_sql, forward_sql, grams, nbest_sql, paths_sql, scratch, seeds, segments, sums_sql, table, typed, unit_sql, vocab
from lexiforge.sources import corpus, vocab_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def re2(characters: str) -> str:
    """A class for DuckDB's expressions, with quotes doubled for SQL."""
    return "[" + "".join("\\" + c if c in "\\[]^-" else c for c in characters).replace("'", "''") + "]"


LET = r"\p{Hiragana}\p{Katakana}ー\p{Han}〇一二三四五六七八九a-zA-Z "
SCRIPT = r"\p{Hiragana}\p{Katakana}ー\p{Han}〇一二三四五六七八九 "


# --- sources -----------------------------------------------------------------------------------


@query("document_lines", "SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))")
def document_lines(s, d):
    return corpus.document_lines(table(s, d, "documents"))


@query("jsonl_text_lines", "SELECT text, count(*) AS n FROM (SELECT unnest(list_append(string_split(coalesce(text, ''), chr(10)), '')) AS text FROM documents) GROUP BY 1")
def jsonl_text_lines(s, d):
    path = scratch(s, "jsonl")
    table(s, d, "documents").select("text").write.json(path)
    return corpus.read_jsonl_text(s, path).groupBy("text").agg(F.count("*").alias("n"))


@query("extract_lines", r"SELECT d.doc_id, regexp_replace(text, '\s+$', '') AS text FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def extract_lines(s, d):
    return corpus.extract_lines(table(s, d, "documents").select("doc_id", "text"), table(s, d, "labels").where("quality = 1"), "doc_id").select("doc_id", "text")


@query("read_line_ids", "SELECT doc_id AS line_id FROM labels WHERE quality = 1")
def read_line_ids(s, d):
    path = scratch(s, "ids")
    table(s, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string")).write.text(path)
    return corpus.read_line_ids(s, path)


@query("sample_corpus", f"SELECT doc_id, source, CAST(n AS INT) AS n_bytes FROM (SELECT doc_id, source, strlen(text) AS n, sum(coalesce(strlen(text), 0)) OVER (PARTITION BY source ORDER BY {unit_sql("'0:' || doc_id")}, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) WHERE run <= 50000")
def sample_corpus(s, d):
    return corpus.sample_corpus(table(s, d, "documents"), 50_000).select("doc_id", "source", F.octet_length("text").alias("n_bytes"))


@query("concat_corpora", "SELECT 'benchmark' AS source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM benchmark UNION ALL SELECT 'conversations', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations")
def concat_corpora(s, d):
    both = corpus.concat_corpora(benchmark=table(s, d, "benchmark").select("text"), conversations=table(s, d, "conversations").select("text"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("freq_files", f"WITH {NG} SELECT token, freq FROM ng")
def freq_files(s, d):
    path = scratch(s, "freq")
    corpus.write_freq(grams(s, d), path)
    return corpus.read_freq(s, path)


@query("vocab_tsv", f"WITH {VOC} SELECT CAST(row_number() OVER (ORDER BY token) - 1 AS INT) AS pos, token, round(ln(theta), 6) AS score FROM voc")
def vocab_tsv(s, d):
    path = scratch(s, "vocab")
    vocab_files.write_vocab(vocab(s, d).withColumnRenamed("token_id", "pos"), path)
    return vocab_files.read_vocab(s, path).withColumn("score", F.round("score", 6))


@query("vocab_json", f"WITH {NG} SELECT token, CAST(freq AS DOUBLE) AS score FROM ng")
def vocab_json(s, d):
    path = scratch(s, "json")
    vocab_files.write_vocab_json(grams(s, d), path)
    return vocab_files.read_vocab_json(s, path).select("token", "score")


@query("save_model", f"WITH {VOC} SELECT token_id, token, freq FROM voc")
def save_model(s, d):
    path = scratch(s, "model")
    vocab_files.save_model(vocab(s, d), path)
    return vocab_files.load_model(s, path).select("token_id", "token", "freq")


@query("write_segmentation", r"SELECT item_id AS line_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ') AS text FROM benchmark")
def write_segmentation(s, d):
    path = scratch(s, "segmentation")
    corpus.write_segmentation(table(s, d, "benchmark").select(F.col("item_id").alias("line_id"), X.words(F.col("text")).alias("pieces")), path)
    ids = N.index_vocab(table(s, d, "benchmark").select("item_id"), "item_id")
    return corpus.read_lines(s, path).join(ids.withColumnRenamed("token_id", "line"), F.col("line_id") == F.col("line")).select(F.col("item_id").alias("line_id"), "text")


@query("read_dictionary_csv", r"""SELECT DISTINCT chr(34) || regexp_split_to_array(text, '\s+')[1] || ', ' || chr(34) AS token FROM benchmark WHERE text IS NOT NULL""")
def read_dictionary_csv(s, d):
    """First words in quotes, with a comma and a blank behind them."""
    path, word = scratch(s, "csv"), F.concat(F.lit('"'), F.split("text", X.SPACE)[0], F.lit(', "'))
    table(s, d, "benchmark").where("text is not null").select(word.alias("a"), "item_id").write.csv(path)
    return corpus.read_dictionary_csv(s, path)


@query("read_seeds", r"SELECT DISTINCT regexp_replace(t, '\s+$', '') AS token FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM benchmark) WHERE regexp_replace(t, '\s+$', '') <> ''")
def read_seeds(s, d):
    path = scratch(s, "seeds")
    table(s, d, "benchmark").select("text").write.text(path)
    return corpus.read_seeds(s, path)


# --- text --------------------------------------------------------------------------------------

LINES_SQL = "lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"


@query(
    "split_symbols",
    rf"WITH {LINES_SQL}, a AS (SELECT doc_id, line_no, left(regexp_replace(text, '\s+$', ''), 1000) AS t FROM lines), b AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(t, '([^ ])([^{LET}])', '\1 \2', 'g'), '([^ ])([^{LET}])', '\1 \2', 'g') AS t FROM a)"
    rf" SELECT doc_id, line_no, regexp_replace(regexp_replace(t, '([^{LET}])([^ ])', '\1 \2', 'g'), '([^{LET}])([^ ])', '\1 \2', 'g') AS text FROM b",
)
def split_symbols(s, d):
    return corpus.document_lines(table(s, d, "documents")).withColumn("text", X.split_symbols(F.col("text")))


@query(
    "split_symbol_runs",
    rf"WITH {LINES_SQL}, a AS (SELECT doc_id, line_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM lines) SELECT doc_id, line_no, regexp_replace(regexp_replace(t, '({re2(RUN_SYMBOLS)})({re2(RUN_SYMBOLS)})', '\1 \2', 'g'), '({re2(RUN_SYMBOLS)})({re2(RUN_SYMBOLS)})', '\1 \2', 'g') AS text FROM a",
)
def split_symbol_runs(s, d):
    return corpus.document_lines(table(s, d, "documents")).withColumn("text", X.split_symbol_runs(F.col("text")))


@query("truncate_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, left(text, 1000) AS text FROM lines")
def truncate_lines(s, d):
    return corpus.document_lines(table(s, d, "documents")).withColumn("text", X.truncate_lines(F.col("text")))


@query("to_segments", f"WITH {SEG} SELECT seg, weight FROM seg")
def to_segments(s, d):
    return segments(s, d)


@query("to_line_segments", rf"WITH {LINES_SQL}, t AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM lines) SELECT '▁' || replace(t, ' ', '▁') AS seg, count(*) AS weight FROM t WHERE t <> '' GROUP BY 1")
def to_line_segments(s, d):
    return N.to_segments(corpus.document_lines(table(s, d, "documents")), space_split=False)


@query("split_sentences", r"SELECT doc_id, CAST(len(p) AS INT) AS n_sentences, CAST(coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS INT) AS longest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.]*[.]|[^.]+') AS p FROM documents)")
def split_sentences(s, d):
    p = X.split_sentences(F.coalesce("text", F.lit("")), r"\.")
    return table(s, d, "documents").select("doc_id", p.alias("p")).select("doc_id", F.size("p").alias("n_sentences"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"))


@query("normalize_for_model", "SELECT item_id, '▁' || replace(text, ' ', '▁') AS text FROM benchmark")
def normalize_for_model(s, d):
    return table(s, d, "benchmark").select("item_id", X.normalize_for_model(F.col("text")).alias("text"))


@query("script_and_symbol_words", f"WITH {WORDS} SELECT lang, count(*) FILTER (WHERE regexp_matches(w, '[{SCRIPT}]')) AS n_script, count(*) FILTER (WHERE regexp_matches(w, '{re2(SYMBOLS)}')) AS n_symbol FROM words GROUP BY lang")
def script_and_symbol_words(s, d):
    w = table(s, d, "documents").select("lang", F.explode(X.words(F.col("text"))).alias("w"))
    return w.groupBy("lang").agg(F.count_if(X.has_script(F.col("w"))).alias("n_script"), F.count_if(X.has_symbol(F.col("w"))).alias("n_symbol"))


@query("contains_keyword", "SELECT doc_id FROM documents WHERE contains(text, 'tion')")
def contains_keyword(s, d):
    return table(s, d, "documents").where(X.contains_keyword(F.col("text"), "tion")).select("doc_id")


@query("split_digits", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([^ ])([0-9])', '\1 \2', 'g'), '([^ ])([0-9])', '\1 \2', 'g'), '([0-9])([^ ])', '\1 \2', 'g'), '([0-9])([^ ])', '\1 \2', 'g') AS text FROM documents")
def split_digits(s, d):
    return table(s, d, "documents").select("doc_id", X.split_digits(F.col("text")).alias("text"))


# --- n-grams -----------------------------------------------------------------------------------


@query("count_ngrams", f"WITH {NG} SELECT token, freq FROM ng")
def count_ngrams(s, d):
    return grams(s, d)


@query("frequent_ngrams", f"WITH {NG.replace(f'least({MAX_LENGTH}, e)', 'least(16, e)')} SELECT token, freq FROM ng WHERE length(token) = 1 OR freq >= {MIN_FREQ}")
def frequent_ngrams(s, d):
    return K.frequent_ngrams(segments(s, d), 16, MIN_FREQ)


@query("seed_vocab", f"WITH {SEEDS} SELECT token, freq FROM seeds")
def seed_vocab(s, d):
    return seeds(s, d)


@query("unigram_total", f"WITH {SEG} SELECT CAST(sum(length(seg) * weight) AS BIGINT) AS unigram_total FROM seg")
def unigram_total(s, d):
    return N.unigram_total(segments(s, d))


BENCH_WORDS = r"bw AS (SELECT DISTINCT w AS token FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark) WHERE w <> '')"


def bench_words(s, d):
    return table(s, d, "benchmark").select(F.explode(X.words(F.col("text"))).alias("token"))


@query("with_initial_seeds", f"WITH {BENCH_WORDS} SELECT token FROM bw")
def with_initial_seeds(s, d):
    return N.with_initial_seeds(bench_words(s, d))


@query("with_fixed_seeds", f"WITH {SEEDS}, {BENCH_WORDS} SELECT token, bool_or(f) AS is_fixed FROM (SELECT token, false AS f FROM seeds UNION ALL SELECT token, true FROM bw) GROUP BY token")
def with_fixed_seeds(s, d):
    return N.with_fixed_seeds(seeds(s, d), bench_words(s, d))


@query("index_vocab", f"WITH {VOC} SELECT token_id, token FROM voc")
def index_vocab(s, d):
    return N.index_vocab(seeds(s, d).select("token"))


@query("effective_max_length", f"WITH {SEEDS} SELECT CAST(max(length(token)) AS INT) AS max_length FROM seeds")
def effective_max_length(s, d):
    return N.effective_max_length(seeds(s, d))


RANDOM = f"ur AS (SELECT token_id, token, {unit_sql("'0:' || token")} AS u FROM voc), vr AS (SELECT token_id, token, u / (SELECT sum(u) FROM ur) AS theta FROM ur)"


@query("init_theta_random", f"WITH {VOC}, {RANDOM} SELECT token, round(theta, 12) AS theta FROM vr")
def init_theta_random(s, d):
    return N.init_theta_random(seeds(s, d).select("token")).select("token", F.round("theta", 12).alias("theta"))


@query("add_word", f"WITH {VOC} SELECT token_id, token FROM voc UNION ALL SELECT CAST(count(*) AS INT), '▁lexiforge' FROM voc")
def add_word(s, d):
    v = vocab(s, d)
    return N.add_word(N.add_word(v, "▁lexiforge"), UNK).select("token_id", "token")


@query("theta_from_counts", f"WITH {WORDS}, {BENCH_WORDS}, k AS (SELECT token FROM bw UNION SELECT '{UNK}'), c AS (SELECT coalesce(k.token, '{UNK}') AS token, count(*) AS n FROM words LEFT JOIN k ON k.token = w GROUP BY 1) SELECT k.token, round((coalesce(n, 0) + 1) / (SELECT sum(n) + (SELECT count(*) FROM k) FROM c), 9) AS theta FROM k LEFT JOIN c USING (token)")
def theta_from_counts(s, d):
    known = N.with_fixed_seeds(bench_words(s, d), bench_words(s, d).limit(0)).select("token").union(s.range(1).select(F.lit(UNK))).distinct()
    out = N.theta_from_counts(table(s, d, "documents").select(X.words(F.col("text")).alias("pieces")), known)
    return out.withColumn("theta", F.round("theta", 9))


@query("vocab_uniform", f"WITH {VOC} SELECT token_id, token, round(1.0 / (SELECT count(*) FROM voc), 12) AS theta FROM voc")
def vocab_uniform(s, d):
    return N.vocab_uniform(seeds(s, d)).select("token_id", "token", F.round("theta", 12).alias("theta"))


@query("vocab_from_unigrams", f"WITH {VOC} SELECT token, round(theta, 12) AS theta FROM voc")
def vocab_from_unigrams(s, d):
    return N.vocab_from_unigrams(seeds(s, d)).withColumn("theta", F.round("theta", 12))


@query("vocab_from_scores", f"WITH {VOC}, {BENCH_WORDS}, k AS (SELECT token FROM bw UNION SELECT token FROM voc), r AS (SELECT k.token, exp(CASE WHEN lp IS NULL OR lp = 0 THEN -30 ELSE lp / 1e6 END) AS p FROM k LEFT JOIN voc USING (token)) SELECT token, round(p / (SELECT sum(p) FROM r), 12) AS theta FROM r")
def vocab_from_scores(s, d):
    v = vocab(s, d)
    out = N.vocab_from_scores(v.select("token", (F.col("lp") / 1e6).alias("score")), v.select("token").union(bench_words(s, d)))
    return out.withColumn("theta", F.round("theta", 12))


@query("substring_freq", rf"WITH t AS (SELECT DISTINCT left(w, 4) AS token FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark) WHERE w <> ''), c AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS x, count(*) AS n FROM conversations GROUP BY 1) SELECT token, CAST(coalesce(sum(n * ((length(x) - length(replace(x, token, ''))) // length(token))), 0) AS BIGINT) AS freq FROM t LEFT JOIN c ON contains(x, token) GROUP BY token")
def substring_freq(s, d):
    return N.substring_freq(table(s, d, "conversations"), bench_words(s, d).select(F.left("token", F.lit(4)).alias("token")))


@query("merge_freq", rf"WITH a AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM benchmark UNION ALL SELECT unnest(regexp_split_to_array(text, '\s+')) FROM conversations) SELECT token, count(*) AS freq FROM a WHERE token <> '' GROUP BY token")
def merge_freq(s, d):
    one = lambda name: table(s, d, name).select(F.explode(X.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
    return N.merge_freq(one("benchmark"), one("conversations"))


@query("top_tokens", f"WITH {NG} SELECT token, freq FROM ng WHERE freq >= 3 ORDER BY freq DESC, token LIMIT 500")
def top_tokens(s, d):
    return N.top_tokens(grams(s, d), 500)


# --- vocabulary tables -------------------------------------------------------------------------

TYPED = f"{VOC}, vt AS (SELECT token_id AS pos, token, CAST(freq AS DOUBLE) AS score FROM voc)"


@query("strip_prefix", f"WITH {TYPED} SELECT min(pos) AS pos, t AS token, CAST(0 AS DOUBLE) AS score FROM (SELECT pos, CASE WHEN starts_with(token, '▁') AND token <> '▁' THEN replace(token, '▁', '') ELSE token END AS t FROM vt) GROUP BY t")
def strip_prefix(s, d):
    return V.strip_prefix(typed(s, d))


@query("strip_prefix_symbols", f"WITH {TYPED} SELECT min(pos) AS pos, t AS token, CAST(0 AS DOUBLE) AS score FROM (SELECT pos, CASE WHEN regexp_matches(token, '^▁[^{LET}]') THEN replace(token, '▁', '') ELSE token END AS t FROM vt) GROUP BY t")
def strip_prefix_symbols(s, d):
    return V.strip_prefix_symbols(typed(s, d))


@query("merge_vocabs", f"WITH {TYPED}, bv AS (SELECT CAST(row_number() OVER (ORDER BY token) - 1 AS INT) AS pos, token FROM (SELECT DISTINCT token FROM (SELECT '▁' || unnest(regexp_split_to_array(text, '\\s+')) AS token FROM benchmark) WHERE token <> '▁')), u AS (SELECT 0 AS file_no, pos, token FROM bv UNION ALL SELECT 1, pos, token FROM vt) SELECT file_no, pos, token, CAST(0 AS DOUBLE) AS score FROM u QUALIFY row_number() OVER (PARTITION BY token ORDER BY file_no, pos) = 1")
def merge_vocabs(s, d):
    words = N.index_vocab(bench_words(s, d).select(F.concat(F.lit(HEAD), "token").alias("token")).distinct()).withColumnRenamed("token_id", "pos")
    return V.merge_vocabs(words, typed(s, d))


@query("reset_special_scores", f"WITH {TYPED} SELECT pos, token, CASE WHEN pos < 100 THEN CASE WHEN contains(token, '▁') THEN -1 ELSE 0 END ELSE score END AS score FROM vt")
def reset_special_scores(s, d):
    return V.reset_special_scores(typed(s, d), 100, True)


@query("assign_piece_types", f"WITH {TYPED} SELECT pos, token, CASE WHEN regexp_matches(token, '^<0x.*>$') THEN 6 WHEN token = '{UNK}' THEN 2 WHEN token IN ('the', '▁') THEN 3 ELSE 1 END AS piece_type FROM vt")
def assign_piece_types(s, d):
    return V.assign_piece_types(typed(s, d), ("the", HEAD)).select("pos", "token", "piece_type")


@query("append_piece", f"WITH {TYPED} SELECT pos, token, score FROM vt UNION ALL SELECT CAST(max(pos) + 1 AS INT), '<tool>', -5 FROM vt")
def append_piece(s, d):
    return V.append_piece(V.assign_piece_types(typed(s, d)), "<tool>", V.USER_DEFINED, -5.0).select("pos", "token", "score")


@query("filter_by_script", f"WITH {SUB} SELECT DISTINCT token FROM (SELECT unnest(regexp_split_to_array(text, '[.]')) AS token FROM benchmark) WHERE regexp_matches(token, '[{SCRIPT}]')")
def filter_by_script(s, d):
    return V.filter_by_script(table(s, d, "benchmark").select(F.explode(F.split("text", "[.]", -1)).alias("token")))


@query("script_ratio", f"WITH {VOC} SELECT count(*) AS size, count(*) FILTER (WHERE regexp_matches(token, '[{SCRIPT}]')) AS script_size, count(*) FILTER (WHERE regexp_matches(token, '[{SCRIPT}]')) / count(*) AS script_ratio FROM voc")
def script_ratio(s, d):
    return V.script_ratio(typed(s, d))


@query("symbol_ratio", f"WITH {VOC}, f AS (SELECT regexp_matches(token, '[{SCRIPT}]') AS a, regexp_matches(token, '{re2(SYMBOLS)}') AS b FROM voc) SELECT count(*) AS size, count(*) FILTER (WHERE a) AS script_size, count(*) FILTER (WHERE a) / count(*) AS script_ratio, count(*) FILTER (WHERE b) AS symbol_size, count(*) FILTER (WHERE a AND b) AS both_size FROM f")
def symbol_ratio(s, d):
    return V.symbol_ratio(typed(s, d))


@query("check_core_seeds", f"WITH {VOC}, core AS (SELECT DISTINCT left(w, 4) AS token FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark)) SELECT token, token IN (SELECT token FROM core) AS is_core FROM voc WHERE contains(token, 'th')")
def check_core_seeds(s, d):
    return V.check_core_seeds(typed(s, d), bench_words(s, d).select(F.left("token", F.lit(4)).alias("token")), "th")


@query("check_non_core_seeds", f"WITH {VOC}, core AS (SELECT DISTINCT left(w, 4) AS token FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark)) SELECT token, false AS is_core FROM voc WHERE contains(token, 'th') AND token NOT IN (SELECT token FROM core)")
def check_non_core_seeds(s, d):
    return V.check_core_seeds(typed(s, d), bench_words(s, d).select(F.left("token", F.lit(4)).alias("token")), "th", only_non_core=True)


PRUNED = f"CASE WHEN token = '{UNK}' THEN 100 WHEN length(token) = 1 THEN greatest(freq, 100) WHEN freq < 100 THEN 0 ELSE freq END"


def counted(s, d):
    """The vocabulary with its frequency as theta: whole numbers, so thresholds compare exactly."""
    return vocab(s, d).select("token_id", "token", F.col("freq").cast("double").alias("theta"))


@query("prune_vocab", f"WITH {VOC} SELECT token_id, token, CAST({PRUNED} AS DOUBLE) AS theta FROM voc")
def prune_vocab(s, d):
    return V.prune_vocab(counted(s, d), 100.0)


@query("shrink_vocab_soft", f"WITH {VOC}, o AS (SELECT token_id, token, freq, rank() OVER (ORDER BY freq DESC) AS r FROM voc WHERE length(token) > 1 AND token <> '{UNK}'), x AS (SELECT count(*) AS n FROM voc WHERE length(token) = 1 OR token = '{UNK}') SELECT token_id, token, CAST(freq AS DOUBLE) AS theta FROM o, x WHERE r <= 2000 - n UNION ALL SELECT token_id, token, CAST(freq AS DOUBLE) FROM voc WHERE length(token) = 1 OR token = '{UNK}'")
def shrink_vocab_soft(s, d):
    return V.shrink_vocab(counted(s, d), 2000, hard_limit=False, keep_char=True)


@query("shrink_vocab_hard", f"WITH {VOC}, o AS (SELECT token_id, token, freq, row_number() OVER (ORDER BY freq DESC, {unit_sql("'0:' || token")}, token) AS r FROM voc WHERE length(token) > 1 AND token <> '{UNK}'), x AS (SELECT count(*) AS n FROM voc WHERE length(token) = 1 OR token = '{UNK}') SELECT token_id, token, CAST(freq AS DOUBLE) AS theta FROM o, x WHERE r <= 2000 - n UNION ALL SELECT token_id, token, CAST(freq AS DOUBLE) FROM voc WHERE length(token) = 1 OR token = '{UNK}'")
def shrink_vocab_hard(s, d):
    return V.shrink_vocab(counted(s, d), 2000, hard_limit=True, keep_char=True)


@query(
    "shrink_vocab_by_total",
    f"WITH {VOC}, k AS (SELECT 2000 - count(*) AS k FROM voc WHERE length(token) = 1), r AS (SELECT freq, row_number() OVER (ORDER BY freq DESC) - 1 AS i FROM voc), t AS (SELECT (SELECT freq FROM r WHERE i = k) AS a, (SELECT freq FROM r WHERE i = k + 1) AS b FROM k),"
    f" h AS (SELECT CASE WHEN a = b THEN coalesce((SELECT min(freq) FROM voc WHERE freq > a), a) ELSE a END AS thre FROM t) SELECT token_id, token, CAST(CASE WHEN token = '{UNK}' THEN thre WHEN length(token) = 1 THEN greatest(freq, thre) WHEN freq < thre THEN 0 ELSE freq END AS DOUBLE) AS theta FROM voc, h",
)
def shrink_vocab_by_total(s, d):
    return V.shrink_vocab_by_total(counted(s, d), 2000)


@query("reindex", f"WITH {VOC} SELECT CAST(row_number() OVER (ORDER BY token_id) - 1 AS INT) AS token_id, token FROM voc WHERE {PRUNED} > 0")
def reindex(s, d):
    return V.reindex(V.prune_vocab(counted(s, d), 100.0)).select("token_id", "token")


@query("ids_by_length", f"WITH {VOC} SELECT CAST(length(token) AS INT) AS len, array_to_string(list(token_id ORDER BY token_id), ',') AS ids FROM voc GROUP BY 1")
def ids_by_length(s, d):
    return V.ids_by_length(vocab(s, d)).select("len", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("many_hot", f"WITH {VOC} SELECT CAST(length(token) AS INT) AS len, token_id FROM voc")
def many_hot(s, d):
    return V.many_hot(vocab(s, d))


CHARS = "ch AS (SELECT CAST(row_number() OVER (ORDER BY token) - 1 AS INT) AS char_id, token AS ch FROM voc WHERE length(token) = 1)"


@query("character_vocab", f"WITH {VOC}, {CHARS} SELECT char_id, ch FROM ch")
def character_vocab(s, d):
    return V.character_vocab(vocab(s, d))


@query("token_char_ids", f"WITH {VOC}, {CHARS}, p AS (SELECT token_id, i, substring(token, i, 1) AS ch FROM (SELECT token_id, token, unnest(range(1, length(token) + 1)) AS i FROM voc)) SELECT token_id, array_to_string(list(coalesce(char_id, -1) ORDER BY i), ',') || repeat(',-1', CAST(greatest(0, 6 - count(*)) AS INT)) AS char_ids FROM p LEFT JOIN ch USING (ch) GROUP BY token_id")
def token_char_ids(s, d):
    return V.token_char_ids(vocab(s, d), 6).select("token_id", F.array_join(F.col("char_ids").cast("array<string>"), ",").alias("char_ids"))


@query("char_token_ids", f"WITH {VOC} SELECT token_id FROM voc WHERE length(token) = 1")
def char_token_ids(s, d):
    return V.char_token_ids(vocab(s, d))


@query("vocab_diff", f"WITH {VOC}, {BENCH_WORDS} SELECT token FROM bw WHERE token NOT IN (SELECT token FROM voc)")
def vocab_diff(s, d):
    return V.vocab_diff(N.with_initial_seeds(bench_words(s, d)), vocab(s, d))


@query("scores_in_order", f"WITH {VOC}, {BENCH_WORDS}, o AS (SELECT CAST(row_number() OVER (ORDER BY token) - 1 AS INT) AS pos, token FROM bw) SELECT pos, o.token, round(ln(coalesce(voc.theta, (SELECT theta FROM voc WHERE token = '{UNK}'))), 6) AS score FROM o LEFT JOIN voc USING (token)")
def scores_in_order(s, d):
    original = N.index_vocab(N.with_initial_seeds(bench_words(s, d))).withColumnRenamed("token_id", "pos")
    return V.scores_in_order(original, vocab(s, d)).withColumn("score", F.round("score", 6))


@query("rename_special", f"WITH {VOC} SELECT token_id, CASE WHEN token = '{UNK}' THEN '<unk|x>' ELSE token END AS token FROM voc")
def rename_special(s, d):
    t = V.assign_piece_types(vocab(s, d).select("token_id", "token"))
    return V.rename_special(t, "x").select("token_id", "token")


SPECIAL_SQL = "sp AS (SELECT CAST(row_number() OVER (ORDER BY g, i) - 1 AS INT) AS pos, token FROM (SELECT 0 AS g, i, ['<unk>', '<s>', '</s>', '<mask>', '<pad>', '<CLS>', '<SEP>', '<EOD>'][i] AS token FROM range(1, 9) t(i) UNION ALL SELECT 1, i, repeat('▁', CAST(25 - i AS INT)) FROM range(1, 25) t(i) UNION ALL SELECT 2, 0, chr(10) UNION ALL SELECT 3, i, format('<0x{:02X}>', i) FROM range(256) t(i)))"


@query("special_rows_first", f"WITH {TYPED}, {SPECIAL_SQL}, u AS (SELECT 0 AS file_no, pos, token FROM sp UNION ALL SELECT 1, pos, token FROM vt) SELECT file_no, pos, token FROM u QUALIFY row_number() OVER (PARTITION BY token ORDER BY file_no, pos) = 1")
def special_rows_first(s, d):
    return V.merge_vocabs(V.special_rows(s), typed(s, d)).select("file_no", "pos", "token")


@query("vocab_sizes", f"WITH {WORDS} SELECT lang AS variant, count(DISTINCT w) AS size FROM words GROUP BY lang")
def vocab_sizes(s, d):
    return V.vocab_sizes(table(s, d, "documents").select(F.col("lang").alias("variant"), F.explode(X.words(F.col("text"))).alias("token")))


@query("tempered", f"WITH {VOC} SELECT token, round(sqrt(theta) / (SELECT sum(sqrt(theta)) FROM voc), 9) AS theta FROM voc")
def tempered(s, d):
    return V.tempered(vocab(s, d), 0.5).select("token", F.round("theta", 9).alias("theta"))


# --- lattices and paths ------------------------------------------------------------------------


@query("lattice", f"WITH {EDGES} SELECT seg, e, l, token_id FROM ed")
def lattice(s, d):
    return L.lattice(segments(s, d), vocab(s, d), MAX_LENGTH).select("seg", "e", "l", "token_id")


@query("candidate_ids", f"WITH {EDGES} SELECT sub.seg, array_to_string(list(voc.token_id ORDER BY e, l), ',') AS ids FROM sub JOIN voc USING (token) GROUP BY sub.seg")
def candidate_ids(s, d):
    packed = L.edge_arrays(L.candidate_ids(segments(s, d), vocab(s, d), MAX_LENGTH))
    return packed.select("seg", F.array_join(F.col("ed.token_id").cast("array<string>"), ",").alias("ids"))


#: Later pieces are looked up with the head mark; every vocabulary token has the same probability.
CONTINUED = f"vu AS MATERIALIZED (SELECT token_id, token, ln(1 / (SELECT count(*) FROM voc)) AS lp FROM voc), {edges_sql('vu', '', "CASE WHEN e > l THEN '▁' || token ELSE token END")}"


@query("continuation_lattice", f"""WITH {VOC}, {edges_sql('voc', '', "CASE WHEN e > l THEN '▁' || token ELSE token END")} SELECT seg, e, l, token_id FROM ed""")
def continuation_lattice(s, d):
    return L.continuation_lattice(segments(s, d), vocab(s, d), HEAD, MAX_LENGTH).select("seg", "e", "l", "token_id")


def scored(s, d, natural: bool = False):
    """Edge arrays with scores: in millionths, or as natural logarithms."""
    v = vocab(s, d)
    return W.lattice_arrays(segments(s, d), matcher(M.with_lp(v) if natural else v, MAX_LENGTH, score="lp"), scored=True)


@query("segment_words", f"WITH RECURSIVE {PATHS} SELECT seg, weight, array_to_string(pieces, ' ') AS pieces, array_to_string(ids, ',') AS ids, CAST(score AS BIGINT) AS score FROM best")
def segment_words(s, d):
    out = S.segment_segments(segments(s, d), vocab(s, d), MAX_LENGTH)
    return out.select("seg", "weight", F.array_join("pieces", " ").alias("pieces"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.col("score").cast("long").alias("score"))


def coded(s, d):
    return S.segment_corpus(table(s, d, "documents"), vocab(s, d), "doc_id", max_length=MAX_LENGTH)


@query("segment_corpus", f"WITH RECURSIVE {PATHS}, w AS (SELECT doc_id, '▁' || x[i] AS seg, i FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda y: y <> '') AS x FROM documents))) SELECT d.doc_id, coalesce(string_agg(array_to_string(pieces, ' '), ' ' ORDER BY i), '') AS pieces FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN best USING (seg) GROUP BY d.doc_id")
def segment_corpus(s, d):
    return coded(s, d).select("doc_id", F.array_join("pieces", " ").alias("pieces"))


@query("lattice_walk", f"WITH {EDGES} SELECT seg, e, l, token_id FROM ed")
def lattice_walk(s, d):
    walked = W.lattice_arrays(segments(s, d), matcher(vocab(s, d), MAX_LENGTH))
    return walked.select("seg", F.inline("ed"))


@query("line_sums")
def line_sums(s, d):
    """Sums over all paths of every document as one line."""
    lines = N.to_segments(table(s, d, "documents"), space_split=False)
    found = W.line_sums(lines, matcher(M.with_lp(vocab(s, d)), MAX_LENGTH, score="lp"))
    return found.select("seg_sha256", F.round("loglik", 3).alias("loglik"), F.round("expected_tokens", 3).alias("expected_tokens"))


@query("segment_long_lines")
def segment_long_lines(s, d):
    return S.segment_long_lines(table(s, d, "documents"), vocab(s, d), "doc_id").select("doc_id", F.array_join("pieces", " ").alias("pieces"))


@query("path_sums", f"WITH RECURSIVE {LN_EDGES}, {sums_sql()} SELECT seg, round(loglik, 6) AS loglik, round(t, 6) AS expected_tokens FROM fa JOIN tot USING (seg)")
def path_sums(s, d):
    return S.line_sums(scored(s, d, natural=True)).select("seg", F.round("loglik", 6).alias("loglik"), F.round("expected_tokens", 6).alias("expected_tokens"))


@query("posteriors", f"WITH RECURSIVE {LN_EDGES}, {sums_sql()} SELECT seg, e, l, token_id, round(p / t, 6) AS post FROM po JOIN tot USING (seg)")
def posteriors(s, d):
    return S.posteriors(S.path_sums(scored(s, d, natural=True))).select("seg", "e", "l", "token_id", F.round("post", 6).alias("post"))


@query(
    "sample_paths",
    f"WITH RECURSIVE {VOC}, vn AS (SELECT token_id, token, 0.5 * ln(theta) AS lp FROM voc), {edges_sql('vn')}, {forward_sql()}, h AS (SELECT seg, e, l, sum(exp(lp + a[e - l + 1] - a[e + 1])) OVER (PARTITION BY seg, e ORDER BY l ROWS UNBOUNDED PRECEDING) AS hi FROM ed JOIN fa USING (seg)),"
    " g AS MATERIALIZED (SELECT seg, e, l, hi, lag(hi, 1, 0) OVER w AS lo, lead(hi) OVER w IS NULL AS is_last FROM h WINDOW w AS (PARTITION BY seg, e ORDER BY l)),"
    f" bk(seg, draw, p, pieces) AS (SELECT seg, draw, length(seg), CAST([] AS VARCHAR[]) FROM seg, (SELECT unnest([1, 2]) AS draw) UNION ALL SELECT bk.seg, draw, p - l, list_prepend(substring(bk.seg, p - l + 1, l), pieces) FROM (SELECT *, {unit_sql("'0:' || seg || ':' || draw || ':' || p")} AS u FROM bk WHERE p > 0) bk JOIN g ON g.seg = bk.seg AND g.e = bk.p AND lo < u AND (u <= hi OR is_last))"
    " SELECT seg, draw, array_to_string(pieces, ' ') AS pieces FROM bk WHERE p = 0",
)
def sample_paths(s, d):
    return S.sample_paths(scored(s, d, natural=True), 2, 0.5).select("seg", "draw", F.array_join("pieces", " ").alias("pieces"))


CUT = "array_to_string(list_transform(range(1, len(lens) + 1), lambda j: substring(seg, CAST(1 + coalesce(list_sum(lens[1:j - 1]), 0) AS BIGINT), lens[j])), ' ')"


@query("nbest_paths", f"WITH RECURSIVE {EDGES}, {nbest_sql(3)} SELECT seg, rank, {CUT} AS pieces, CAST(score AS BIGINT) AS score FROM nbest")
def nbest_paths(s, d):
    return S.nbest_paths(scored(s, d), 3).select("seg", "rank", F.array_join("pieces", " ").alias("pieces"), F.col("score").cast("long").alias("score"))


def searched(df: DataFrame) -> DataFrame:
    return df.select("seg", "rank", F.array_join("pieces", " ").alias("pieces"), F.col("score").cast("long").alias("score"))


@query("nbest_astar", f"WITH RECURSIVE {EDGES}, {nbest_sql(3)} SELECT seg, rank, {CUT} AS pieces, CAST(score AS BIGINT) AS score FROM nbest")
def nbest_astar(s, d):
    return searched(B.nbest_astar(segments(s, d), matcher(vocab(s, d), MAX_LENGTH, score="lp"), 3))


@query("nbest_lines")
def nbest_lines(s, d):
    lines = N.to_segments(table(s, d, "documents"), space_split=False)
    found = searched(B.nbest_astar(lines, matcher(vocab(s, d), MAX_LENGTH, score="lp"), 3))
    return found.withColumn("seg", F.sha2("seg", 256))


@query("nbest_point", f"WITH RECURSIVE {EDGES}, {nbest_sql(3)} SELECT seg, rank, {CUT} AS pieces, CAST(score AS BIGINT) AS score FROM nbest")
def nbest_point(s, d):
    return searched(B.nbest_point(segments(s, d), matcher(vocab(s, d), MAX_LENGTH, score="lp"), 3, exact=True))


@query("nbest_point_share")
def nbest_point_share(s, d):
    """How many of the three best paths of every word the search by boundaries finds."""
    words, tries = segments(s, d), matcher(vocab(s, d), MAX_LENGTH, score="lp")
    return B.found_share(B.nbest_point(words, tries, 3), B.nbest_astar(words, tries, 3))


@query("sample_from_nbest", f"WITH RECURSIVE {EDGES}, {nbest_sql(4)} SELECT seg, rank, {CUT} AS pieces FROM nbest QUALIFY row_number() OVER (PARTITION BY seg ORDER BY score * 1e-6 - ln(-ln({unit_sql("'0:' || seg || ':' || rank")})) DESC) <= 2")
def sample_from_nbest(s, d):
    return S.sample_from_nbest(scored(s, d), 2, 4, 1e-6).select("seg", "rank", F.array_join("pieces", " ").alias("pieces"))


@query("pieces_to_ids", f"WITH {VOC}, w AS (SELECT item_id, x[i] AS token, i FROM (SELECT item_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda y: y <> '') AS x FROM benchmark))) SELECT item_id, string_agg(coalesce(voc.token_id, (SELECT token_id FROM voc WHERE token = '{UNK}'))::VARCHAR, ',' ORDER BY i) AS ids FROM w LEFT JOIN voc USING (token) GROUP BY item_id")
def pieces_to_ids(s, d):
    lines = table(s, d, "benchmark").select("item_id", X.words(F.col("text")).alias("pieces"))
    return S.pieces_to_ids(lines, vocab(s, d), "item_id").select("item_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("ids_to_pieces", f"WITH {VOC}, w AS (SELECT item_id, x[i] AS token, i FROM (SELECT item_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda y: y <> '') AS x FROM benchmark))) SELECT item_id, string_agg(coalesce(voc.token, '{UNK}'), ' ' ORDER BY i) AS pieces FROM w LEFT JOIN voc USING (token) GROUP BY item_id")
def ids_to_pieces(s, d):
    v = vocab(s, d)
    lines = table(s, d, "benchmark").select("item_id", X.words(F.col("text")).alias("pieces"))
    return S.ids_to_pieces(S.pieces_to_ids(lines, v, "item_id"), v, "item_id").select("item_id", F.array_join("pieces", " ").alias("pieces"))


@query("decode_corpus", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''), ' ') AS text FROM documents")
def decode_corpus(s, d):
    v = vocab(s, d)
    lines = S.segment_corpus(table(s, d, "documents"), v, "doc_id", max_length=MAX_LENGTH)
    return lines.select("doc_id", X.decode_pieces(F.col("pieces")).alias("text"))


@query("decode_malformed", r"SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', chr(65533), 'g'), '^ ', '') AS text FROM documents")
def decode_malformed(s, d):
    """Texts whose characters beyond ASCII have lost all bytes but the first."""
    first = lambda c: F.when(F.octet_length(c) > 1, F.get(X.byte_pieces(c), 0)).otherwise(c)
    docs = table(s, d, "documents").select("doc_id", F.transform(X.chars(F.coalesce("text", F.lit(""))), first).alias("pieces"))
    return docs.select("doc_id", X.decode_pieces(F.col("pieces")).alias("text"))


@query("byte_fallback", r"WITH t AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), '') AS text FROM benchmark) SELECT item_id, text, array_to_string(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN regexp_matches(substring(text, i, 1), '[a-z]') THEN substring(text, i, 1) ELSE rtrim(regexp_replace(hex(encode(substring(text, i, 1))), '(..)', '<0x\1> ', 'g')) END), ' ') AS pieces FROM t")
def byte_fallback(s, d):
    chars = X.chars(F.array_join(X.words(F.col("text")), ""))
    known = F.transform(chars, lambda c: c.rlike("[a-z]"))
    rows = table(s, d, "benchmark").select("item_id", X.byte_fallback(chars, known).alias("p"))
    return rows.select("item_id", F.array_join("p", " ").alias("pieces"), X.decode_pieces(F.col("p")).alias("text"))


@query("add_eod", "WITH c AS (SELECT item_id, array_to_string(list_transform(range(1, length(text) + 1), lambda i: unicode(substring(text, i, 1))), ',') || ',0' AS x, length(text) + 1 AS n FROM benchmark) SELECT item_id, x || ',' || x AS ids, repeat('0', CAST(n AS INT)) || repeat('1', CAST(n AS INT)) AS types FROM c")
def add_eod(s, d):
    ids = F.transform(X.chars(F.col("text")), lambda c: F.ascii(c))
    rows = table(s, d, "benchmark").select("item_id", X.add_eod(ids, 0, ids).alias("ids"), X.type_ids(ids, ids).alias("t"))
    joined = lambda c, by: F.array_join(F.col(c).cast("array<string>"), by)
    return rows.select("item_id", joined("ids", ",").alias("ids"), joined("t", "").alias("types"))


@query("vocab_size", f"WITH {VOC} SELECT count(*) AS vocab_size FROM voc")
def vocab_size(s, d):
    return S.vocab_size(vocab(s, d))


# --- training ----------------------------------------------------------------------------------


#: Scores of best paths are whole millionths, so that equal paths tie in SQL too.
TICKS = 1e6


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select("token_id", "token", F.round("theta", digits).alias("theta"))


@query("train_em", f"WITH RECURSIVE {LN_EDGES}, {sums_sql()}, n AS (SELECT voc.token_id, token, coalesce(m, 0) + 1e-30 AS m FROM voc LEFT JOIN mass USING (token_id)) SELECT token_id, token, round(m / (SELECT sum(m) FROM n), 9) AS theta FROM n")
def train_em(s, d):
    return rounded(M.train_em(segments(s, d), vocab(s, d).drop("lp", "freq"), 1, max_length=MAX_LENGTH))


@query("train_em_lines")
def train_em_lines(s, d):
    """One iteration over whole documents as lines."""
    lines = N.to_segments(table(s, d, "documents"), space_split=False)
    return rounded(M.train_em(lines, vocab(s, d).drop("lp", "freq"), 1, max_length=MAX_LENGTH))


@query("em_mass", f"WITH RECURSIVE {LN_EDGES}, {sums_sql()} SELECT token_id, round(m, 4) AS mass FROM mass")
def em_mass(s, d):
    v = vocab(s, d)
    arrays = W.lattice_arrays(segments(s, d), matcher(v, MAX_LENGTH))
    return M.em_counts(arrays, v.drop("lp")).select("token_id", F.round("mass", 4).alias("mass"))


@query("train_viterbi", f"WITH RECURSIVE {PATHS}, c AS (SELECT token_id, sum(weight) AS n FROM (SELECT unnest(ids) AS token_id, weight FROM best) GROUP BY 1) SELECT voc.token_id, token, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 9) AS theta FROM voc LEFT JOIN c USING (token_id)")
def train_viterbi(s, d):
    return rounded(M.train_viterbi(segments(s, d), vocab(s, d).drop("lp", "freq"), 1, max_length=MAX_LENGTH, ticks=TICKS))


@query("train_viterbi_em")
def train_viterbi_em(s, d):
    return rounded(M.train_viterbi(segments(s, d), vocab(s, d).drop("lp", "freq"), 1, max_length=MAX_LENGTH))


@query(
    "train_viterbi_batch",
    f"WITH RECURSIVE {PATHS}, nb AS (SELECT greatest(1, count(*) // 4096) AS n FROM seg), tk AS (SELECT floor({unit_sql("'0:' || seg")} * nb.n) AS b, unnest(ids) AS token_id, weight FROM best, nb), c AS (SELECT b, token_id, sum(weight) AS k FROM tk GROUP BY 1, 2),"
    " t AS (SELECT b, sum(k) AS t FROM c GROUP BY b), sh AS (SELECT token_id, sum(k / t) AS share FROM c JOIN t USING (b) GROUP BY 1) SELECT voc.token_id, token, round(coalesce(share, 0) / (SELECT sum(share) FROM sh), 9) AS theta FROM voc LEFT JOIN sh USING (token_id)",
)
def train_viterbi_batch(s, d):
    return rounded(M.train_viterbi_batch(segments(s, d), vocab(s, d).drop("lp", "freq"), batch=4096, max_length=MAX_LENGTH, ticks=TICKS))


def step_sql(batches: int = 1, step: int = 0, old: str = "voc", paths: str = "best", new: str = "v1") -> str:
    """``new``: the probabilities of ``old`` moved towards the relative counts of one of the batches."""
    rate = (step + 2) ** -0.8
    return f"""k{step} AS (SELECT token_id, sum(weight) AS n FROM (SELECT unnest(ids) AS token_id, weight FROM {paths} WHERE floor({unit_sql("'0:' || seg")} * {batches}) = {step}) GROUP BY 1),
{new} AS (SELECT token_id, token, theta, round(ln(theta) * 1e6) AS lp FROM (SELECT v.token_id, token, theta * (1 - {rate!r}::DOUBLE) + coalesce(n, 0) / (SELECT sum(n) FROM k{step}) * {rate!r}::DOUBLE AS theta FROM {old} v LEFT JOIN k{step} USING (token_id)))"""


@query("train_viterbi_first_step", f"WITH RECURSIVE {PATHS}, {step_sql()} SELECT token_id, token, round(theta, 9) AS theta FROM v1")
def train_viterbi_first_step(s, d):
    return rounded(M.train_viterbi_stepwise(segments(s, d), vocab(s, d).drop("lp", "freq"), 1, max_length=MAX_LENGTH, ticks=TICKS))


@query("train_viterbi_stepwise")
def train_viterbi_stepwise(s, d):
    return rounded(M.train_viterbi_stepwise(segments(s, d), vocab(s, d).drop("lp", "freq"), 2, max_length=MAX_LENGTH, ticks=TICKS))


@query("train_vocab")
def train_vocab(s, d):
    v = vocab(s, d).drop("lp", "freq")
    return rounded(M.train_vocab(segments(s, d), v, int(v.count() * 0.8), 0.8, 1, "viterbi", keep_char=True))


UNIFORM = "vu AS MATERIALIZED (SELECT token_id, token, round(ln(1 / (SELECT count(*) FROM voc)) * 1e6) AS lp FROM voc)"


@query("reestimate_scores", f"WITH RECURSIVE {VOC}, {UNIFORM}, {edges_sql('vu')}, {paths_sql()}, c AS (SELECT token_id, sum(weight) AS n FROM (SELECT unnest(ids) AS token_id, weight FROM best) GROUP BY 1), r AS (SELECT token_id, ln(n / (SELECT sum(n) FROM c)) AS score FROM c) SELECT voc.token_id AS pos, token, round(coalesce(score, (SELECT score FROM r JOIN voc USING (token_id) WHERE token = '{UNK}')), 6) AS score FROM voc LEFT JOIN r USING (token_id)")
def reestimate_scores(s, d):
    v = vocab(s, d).select(F.col("token_id").alias("pos"), "token")
    return M.reestimate_scores(v, segments(s, d), "viterbi", 1, MAX_LENGTH, TICKS).withColumn("score", F.round("score", 6))


@query("retrain_wordpiece_vocab", f"WITH RECURSIVE {VOC}, {CONTINUED}, {sums_sql()}, n AS (SELECT voc.token_id, token, coalesce(m, 0) + 1e-30 AS m FROM voc LEFT JOIN mass USING (token_id)) SELECT token_id, token, round(m / (SELECT sum(m) FROM n), 9) AS theta FROM n")
def retrain_wordpiece_vocab(s, d):
    return rounded(M.retrain_wordpiece_vocab(vocab(s, d).drop("lp", "freq"), segments(s, d), 1, HEAD))


@query(
    "train_corpus_once",
    f"WITH RECURSIVE {VOC}, {RANDOM}, vt AS MATERIALIZED (SELECT token_id, token, round(ln(theta) * 1e6) AS lp FROM vr), {edges_sql('vt')}, {paths_sql()}, c AS (SELECT token_id, sum(weight) AS n FROM (SELECT unnest(ids) AS token_id, weight FROM best) GROUP BY 1),"
    f" r AS (SELECT voc.token_id, token, coalesce(n, 0) / (SELECT sum(n) FROM c) AS theta, 0.5::DOUBLE / (SELECT sum(length(seg) * weight) FROM seg) AS low FROM voc LEFT JOIN c USING (token_id)), p AS (SELECT token_id, token, CASE WHEN token = '{UNK}' THEN low WHEN length(token) = 1 THEN greatest(theta, low) WHEN theta < low THEN 0 ELSE theta END AS theta FROM r)"
    " SELECT CAST(row_number() OVER (ORDER BY token_id) - 1 AS INT) AS token_id, token, round(theta / (SELECT sum(theta) FROM p), 9) AS theta FROM p WHERE theta > 0",
)
def train_corpus_once(s, d):
    return rounded(M.train_corpus(table(s, d, "documents"), MAX_LENGTH, MIN_FREQ, 1, "viterbi", ticks=TICKS))


LOSSES = f"""WITH RECURSIVE {VOC}, lo AS (WITH RECURSIVE seg AS (SELECT token AS seg FROM voc WHERE token <> '{UNK}'), ed AS (SELECT seg, CAST(e AS INT) AS e, CAST(l AS INT) AS l, v.lp FROM (SELECT seg, e, unnest(range(1, e + 1)) AS l FROM (SELECT seg, unnest(range(1, length(seg) + 1)) AS e FROM seg)) x
  JOIN voc v ON v.token = substring(seg, e - l + 1, l) AND v.token <> '{UNK}'), {nbest_sql(2)} SELECT seg AS token, rank, list_transform(range(1, len(lens) + 1), lambda j: substring(seg, CAST(1 + coalesce(list_sum(lens[1:j - 1]), 0) AS BIGINT), lens[j])) AS pieces FROM nbest),
m AS (SELECT p.token, sum(ln(a.theta + t.theta)) AS s, count(*) AS n FROM (SELECT token, unnest(pieces) AS piece FROM lo WHERE rank = 2) p JOIN voc a ON a.token = p.piece JOIN voc t ON t.token = p.token GROUP BY 1)
SELECT voc.token_id, CASE WHEN f.token IS NOT NULL THEN 0 WHEN n IS NULL THEN -1 ELSE round(theta * (ln(theta) - s + n * ln(1 + theta * (n - 1))), 12) END AS loss FROM voc LEFT JOIN m USING (token) LEFT JOIN (SELECT token FROM lo WHERE rank = 1 AND len(pieces) > 1) f USING (token)"""


@query("token_losses", LOSSES)
def token_losses(s, d):
    """-1 stands for a token that nothing can replace."""
    found = M.token_losses(vocab(s, d).drop("lp"), TICKS)
    return found.select("token_id", F.when(F.col("loss") == float("inf"), -1.0).otherwise(F.round("loss", 12)).alias("loss"))


@query("train_vocab_by_loss")
def train_vocab_by_loss(s, d):
    v = vocab(s, d).drop("lp", "freq")
    return rounded(M.train_vocab(segments(s, d), v, int(v.count() * 0.8), 0.8, 1, "em", keep_char=True, by="loss"))


@query("train_corpus")
def train_corpus(s, d):
    return rounded(M.train_corpus(table(s, d, "documents"), 5, 50, 10, "viterbi"))


@query("train_language_vocab")
def train_language_vocab(s, d):
    return rounded(M.train_language_vocab(table(s, d, "documents"), 6000, 16, 30, byte_fallback=True))


# --- evaluation --------------------------------------------------------------------------------

TOKENS = f"WITH RECURSIVE {PATHS}, tok AS (SELECT unnest(ids) AS token_id, weight FROM best)"


@query(
    "encoding_stats",
    f"{TOKENS}, c AS (SELECT token_id, CAST(sum(weight) AS BIGINT) AS n FROM tok GROUP BY 1), v AS (SELECT n, token = '{UNK}' AS u FROM c JOIN voc USING (token_id)) SELECT CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN u THEN 0 ELSE n END) AS BIGINT) AS n_kept, CAST(sum(CASE WHEN u THEN n ELSE 0 END) AS BIGINT) AS n_unk, count(*) AS n_types FROM v",
)
def encoding_stats(s, d):
    unk = vocab(s, d).where(F.col("token") == UNK).collect()[0]["token_id"]
    return E.encoding_stats(coded(s, d), {"unk": unk})


@query("perplexity_model", f"{TOKENS}, c AS (SELECT token_id, sum(weight) AS n FROM tok GROUP BY 1) SELECT round(exp(-sum(n * lp) / 1e6 / sum(n)), 4) AS perplexity FROM c JOIN voc USING (token_id)")
def perplexity_model(s, d):
    v = vocab(s, d)
    return E.perplexity_model(coded(s, d), v.withColumn("lp", F.col("lp") / 1e6)).select(F.round("perplexity", 4).alias("perplexity"))


@query("perplexity_new_unigram", f"{TOKENS}, c AS (SELECT token_id, sum(weight) AS n FROM tok GROUP BY 1) SELECT round(exp(-sum(n / t * ln(n / t))), 4) AS perplexity FROM c, (SELECT sum(n) AS t FROM c)")
def perplexity_new_unigram(s, d):
    return E.perplexity_new_unigram(coded(s, d)).select(F.round("perplexity", 4).alias("perplexity"))


@query("loglik_per_token", f"WITH RECURSIVE {PATHS} SELECT round(sum(score * weight) / sum(n * weight), 4) AS loglik_per_token FROM best")
def loglik_per_token(s, d):
    return E.loglik_per_token(S.segment_segments(segments(s, d), vocab(s, d), MAX_LENGTH)).select(F.round("loglik_per_token", 4).alias("loglik_per_token"))


@query("chars_per_token", f"WITH RECURSIVE {PATHS}, w AS (SELECT lang, '▁' || w AS seg FROM words) SELECT lang, CAST(sum(length(seg)) AS BIGINT) AS n_chars, CAST(sum(n) AS BIGINT) AS n_tokens, round(sum(length(seg)) / sum(n), 6) AS chars_per_token FROM w JOIN best USING (seg) GROUP BY lang")
def chars_per_token(s, d):
    words = table(s, d, "documents").select("lang", F.explode(X.words(F.col("text"))).alias("w")).select("lang", F.concat(F.lit(HEAD), "w").alias("seg")).groupBy("lang", "seg").agg(F.count("*").alias("k"))
    solved = S.segment_segments(segments(s, d), vocab(s, d), MAX_LENGTH).select("seg", F.size("ids").alias("n"))
    rows = words.join(solved, "seg").select("lang", (F.length("seg") * F.col("k")).alias("n_chars"), (F.col("n") * F.col("k")).alias("n_tokens"))
    return E.chars_per_token(rows).withColumn("chars_per_token", F.round("chars_per_token", 6))


@query("bi_tags", f"WITH {LINES_SQL}, t AS (SELECT item_id, string_agg('B' || repeat('I', CAST(length(x[i]) - 1 AS INT)), '' ORDER BY i) AS b FROM (SELECT item_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda y: y <> '') AS x FROM benchmark)) GROUP BY item_id) SELECT item_id, CAST(k - 1 AS INT) AS char_pos, substring(b, k, 1) AS tag FROM (SELECT item_id, b, unnest(range(1, length(b) + 1)) AS k FROM t)")
def bi_tags(s, d):
    return E.bi_tags(table(s, d, "benchmark"), "item_id")


REPORT_DOCS = r"""gold AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda y: y <> '') AS g FROM documents), pred AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(coalesce(text, ''), 't', 't '), '\s+'), lambda y: y <> '') AS p FROM documents),
bits AS (SELECT array_to_string(list_transform(g, lambda x: 'B' || repeat('I', CAST(length(x) - 1 AS INT))), '') AS g, array_to_string(list_transform(p, lambda x: 'B' || repeat('I', CAST(length(x) - 1 AS INT))), '') AS p FROM gold JOIN pred USING (doc_id)),
cells AS (SELECT g, p, count(*) AS n FROM (SELECT substring(g, i, 1) AS g, substring(p, i, 1) AS p FROM (SELECT g, p, unnest(range(1, length(g) + 1)) AS i FROM bits)) GROUP BY 1, 2)"""


def gold_and_pred(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", "text"), docs.select("doc_id", F.replace("text", F.lit("t"), F.lit("t ")).alias("text"))


@query("tag_counts", f"WITH {REPORT_DOCS} SELECT g AS gold, p AS pred, n FROM cells")
def tag_counts(s, d):
    return E.tag_counts(*gold_and_pred(s, d), "doc_id")


@query(
    "segmentation_report",
    f"""WITH {REPORT_DOCS}, q AS (SELECT t AS label, coalesce(sum(n) FILTER (WHERE g = t AND p = t), 0) AS tp, sum(n) FILTER (WHERE p = t) AS pp, sum(n) FILTER (WHERE g = t) AS pg FROM cells, (SELECT unnest(['B', 'I']) AS t) GROUP BY t),
f AS (SELECT label, tp, pg, tp / pp AS p, tp / pg AS r, 2 * (tp / pp) * (tp / pg) / (tp / pp + tp / pg) AS f FROM q), a AS (SELECT sum(tp) / sum(pg) AS acc, sum(pg) AS n, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(p * pg) / sum(pg) AS wp, sum(r * pg) / sum(pg) AS wr, sum(f * pg) / sum(pg) AS wf FROM f)
SELECT label, round(p, 3) AS precision, round(r, 3) AS recall, round(f, 3) AS f1, CAST(pg AS BIGINT) AS support FROM f UNION ALL SELECT 'accuracy', round(acc, 3), round(acc, 3), round(acc, 3), CAST(n AS BIGINT) FROM a
UNION ALL SELECT 'macro avg', round(mp, 3), round(mr, 3), round(mf, 3), CAST(n AS BIGINT) FROM a UNION ALL SELECT 'weighted avg', round(wp, 3), round(wr, 3), round(wf, 3), CAST(n AS BIGINT) FROM a""",
)
def segmentation_report(s, d):
    return E.segmentation_report(E.tag_counts(*gold_and_pred(s, d), "doc_id"))


@query("compare_segmentations", "SELECT doc_id, coalesce(doc_id % 7 <> 3 AND NOT contains(text, 'z'), false) AS same_pieces, doc_id % 7 <> 3 AND doc_id % 3 = doc_id % 2 AS same_ids, coalesce(doc_id % 7 <> 3 AND NOT contains(text, 'q'), false) AS round_trip FROM documents")
def compare_segmentations(s, d):
    """Pieces differ where a text has a z, ids by number, texts where a q was changed; one in seven lines is missing."""
    docs = table(s, d, "documents").select("doc_id", "text")
    a = docs.select("doc_id", F.concat(F.array(F.lit(HEAD)), F.split("text", "(?<=z)")).alias("pieces"), F.array((F.col("doc_id") % 3).cast("int")).alias("ids"))
    b = docs.where(F.col("doc_id") % 7 != 3).select("doc_id", F.array(F.lit(HEAD), "text").alias("pieces"), F.array((F.col("doc_id") % 2).cast("int")).alias("ids"))
    texts = docs.withColumn("text", F.translate("text", "q", "k"))
    return E.compare_segmentations(b, a, texts, "doc_id")


# --- conversations -----------------------------------------------------------------------------


def tagged_ids(s, d):
    """(conv_id, token_ids): start, role, message marker, the text's code points, end; every marker is below 10."""
    rows = table(s, d, "conversations")
    code = lambda c: F.transform(X.chars(c), lambda x: F.ascii(x) + 10)
    m = MARKERS
    ids = lambda x: F.concat(F.array(F.lit(m["<|start|>"])), code(x["role"]), F.array(F.lit(m["<|message|>"])), code(F.coalesce(x["text"], F.lit(""))), F.array(F.lit(m["<|end|>"])))
    texts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))  # texts travel, not ids
    return texts.select("conv_id", F.flatten(F.transform("m", ids)).alias("token_ids"))


MESSAGES_SQL = "m AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS msg_no, count(*) OVER (PARTITION BY conv_id) AS k, role, coalesce(text, '') AS text FROM conversations)"


@query("parse_messages", f"WITH {MESSAGES_SQL} SELECT conv_id, msg_no, 'END' AS \"end\", CAST(length(role) AS INT) AS n_role, CAST(length(text) AS INT) AS n_content, CAST(1 + coalesce(sum(3 + length(role) + length(text)) OVER (PARTITION BY conv_id ORDER BY msg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS role_start FROM m")
def parse_messages(s, d):
    out = C.parse_messages(tagged_ids(s, d), MARKERS)
    return out.select("conv_id", "msg_no", "end", F.size("role.token_ids").alias("n_role"), F.size("content.token_ids").alias("n_content"), F.col("role.start").alias("role_start"))


@query("parse_messages_reverse", f"WITH {MESSAGES_SQL} SELECT conv_id, CAST(k - 1 - msg_no AS INT) AS reverse_no, CAST(length(role) AS INT) AS n_role, CAST(length(text) AS INT) AS n_content FROM m")
def parse_messages_reverse(s, d):
    out = C.parse_messages_reverse(tagged_ids(s, d), MARKERS)
    return out.select("conv_id", "reverse_no", F.size("role.token_ids").alias("n_role"), F.size("content.token_ids").alias("n_content"))


@query("decode_messages", f"WITH {MESSAGES_SQL} SELECT conv_id, string_agg('<|start|>' || role || '<|message|>' || text || '<|end|>', '' ORDER BY msg_no) AS text FROM m GROUP BY conv_id")
def decode_messages(s, d):
    rows = table(s, d, "conversations")
    pieces = F.array(F.lit("<|start|>"), F.concat(F.lit(HEAD), "role"), F.lit("<|message|>"), F.concat(F.lit(HEAD), F.coalesce("text", F.lit(""))), F.lit("<|end|>"))
    joined = rows.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", pieces.alias("p")))), lambda x: x["p"])).alias("pieces"))
    # A piece behind a marker begins a text of its own, so its head mark is dropped.
    return C.decode_messages(joined)


SYSTEM = C.system_block("You are a helpful assistant.", "2025-12", "2026-01-01")
SYSTEM_SQL = "'" + SYSTEM.replace("'", "''") + "'"

#: Conversations with calls, tool turns, thinking and text that looks like a message, all taken from the table.
TALK = r"""talk AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'tool' ELSE role END AS role,
  CASE WHEN role = 'assistant' AND conv_id % 17 = 3 THEN '<|channel|>final<|message|>' || coalesce(text, '') WHEN role = 'assistant' AND turn % 3 = 1 AND conv_id % 4 = 1 THEN NULL ELSE text END AS text,
  CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN left(coalesce(text, ''), 20) END AS thinking, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'f' || (conv_id % 5) END AS tool_name,
  CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN '{"n": "' || conv_id || '"}' END AS tool_arguments FROM conversations)"""
RENDER = rf"""{TALK}, q AS (SELECT *, row_number() OVER w AS no, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS at_end, role = 'assistant' AND tool_name IS NOT NULL AS is_call, role = 'assistant' AND tool_name IS NULL AS is_answer FROM talk WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, coalesce(max(CAST(is_answer AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS ahead,
  last_value(CASE WHEN is_call THEN tool_name WHEN is_answer AND NOT at_end THEN '' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tool, coalesce(nullif(text, ''), nullif(thinking, '')) AS thought FROM q),
t AS (SELECT conv_id, turn, CASE WHEN no = 1 AND role IN ('system', 'developer') AND coalesce(text, '') <> '' THEN '<|start|>developer<|message|># Instructions' || chr(10) || chr(10) || text || chr(10) || chr(10) || '<|end|>' WHEN no = 1 AND role IN ('system', 'developer') THEN ''
 WHEN is_call THEN CASE WHEN thought IS NOT NULL AND NOT ahead THEN '<|start|>assistant<|channel|>analysis<|message|>' || thought || '<|end|>' ELSE '' END || '<|start|>assistant to=functions.' || tool_name || '<|channel|>commentary json<|message|>' || tool_arguments || '<|call|>'
 WHEN is_answer THEN CASE WHEN at_end AND thinking IS NOT NULL THEN '<|start|>assistant<|channel|>analysis<|message|>' || thinking || '<|end|>' ELSE '' END || '<|start|>assistant<|channel|>final<|message|>' || coalesce(text, '') || CASE WHEN at_end THEN '<|return|>' ELSE '<|end|>' END
 WHEN role = 'tool' THEN '<|start|>functions.' || coalesce(tool, '') || ' to=assistant<|channel|>commentary<|message|>' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '<|end|>'
 WHEN role = 'user' THEN '<|start|>user<|message|>' || coalesce(text, '') || '<|end|>' ELSE '' END AS x FROM r)"""


def talk(s, d):
    rows, c, turn, text = table(s, d, "conversations"), F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    answer = F.col("role") == "assistant"
    call = answer & (turn % 3 == 1)
    said = F.when(answer & (c % 17 == 3), F.concat(F.lit("<|channel|>final<|message|>"), text)).when(~(call & (c % 4 == 1)), F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when((F.col("role") == "user") & (turn % 4 == 2), "tool").otherwise(F.col("role")).alias("role"),
        said.alias("text"),
        F.when(answer & (c % 2 == 0), F.left(text, F.lit(20))).alias("thinking"),
        F.when(call, F.concat(F.lit("f"), (c % 5).cast("string"))).alias("tool_name"),
        F.when(call, F.concat(F.lit('{"n": "'), c.cast("string"), F.lit('"}'))).alias("tool_arguments"),
    )


def rendered(s, d):
    return C.render_conversations(talk(s, d), SYSTEM)


@query("render_conversations", f"WITH {RENDER} SELECT conv_id, {SYSTEM_SQL} || string_agg(x, '' ORDER BY turn) AS rendered FROM t GROUP BY conv_id")
def render_conversations(s, d):
    return rendered(s, d)


#: Texts as a model gives them: the recipient stands behind the channel.
ANSWERED = f"{RENDER}, a AS (SELECT conv_id, regexp_replace({SYSTEM_SQL} || string_agg(x, '' ORDER BY turn), '( to=functions[.][a-z0-9]+)<[|]channel[|]>commentary', '<|channel|>commentary\\1', 'g') AS x FROM t GROUP BY conv_id)"


@query(
    "extract_response_fields",
    f"WITH {ANSWERED}, p AS (SELECT conv_id, n, p, split_part(p, '<|message|>', 1) AS head FROM (SELECT conv_id, unnest(string_split(x, '<|channel|>')[2:]) AS p, unnest(range(2, len(string_split(x, '<|channel|>')) + 1)) AS n FROM a) WHERE contains(p, '<|message|>')),"
    " b AS (SELECT conv_id, n, head, regexp_extract(substring(p, length(head) + 12), '(?s)^(.*?)(<[|]end[|]>|<[|]return[|]>|<[|]call[|]>|$)', 1) AS body, regexp_extract(substring(p, length(head) + 12), '(?s)^(.*?)(<[|]end[|]>|<[|]return[|]>|<[|]call[|]>|$)', 2) AS stop FROM p)"
    " SELECT a.conv_id, arg_min(body, n) FILTER (head = 'final') AS content, arg_min(body, n) FILTER (head = 'analysis' AND stop = '<|end|>') AS thinking, coalesce(string_agg(split_part(substring(head, 25), ' ', 1) || ':' || CASE WHEN starts_with(head, 'commentary to=functions.') THEN json_extract_string(body, '$.n') END, ',' ORDER BY n) FILTER (starts_with(head, 'commentary to=functions.')), '') AS calls FROM a LEFT JOIN b USING (conv_id) GROUP BY a.conv_id",
)
def extract_response_fields(s, d):
    told = rendered(s, d).withColumn("rendered", F.regexp_replace("rendered", r"( to=functions\.[a-z0-9]+)<\|channel\|>commentary", "<|channel|>commentary$1"))
    calls = F.transform("tool_calls", lambda c: F.concat_ws(":", c["name"], c["arguments"]["n"]))
    return C.extract_response_fields(told, "rendered").select("conv_id", "content", "thinking", F.array_join(calls, ",").alias("calls"))


@query(
    "invalid_turns",
    f"""WITH {TALK}, o AS (SELECT *, coalesce(last_value(CASE WHEN role = 'assistant' THEN CAST(tool_name IS NOT NULL AS INT) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS is_open FROM talk)
SELECT conv_id, turn, CASE WHEN role = 'assistant' AND contains(text, '<|channel|>final<|message|>') THEN 'marker in content' WHEN role = 'assistant' AND tool_name IS NOT NULL AND text <> '' AND thinking <> '' THEN 'content and thinking with a tool call' ELSE 'tool turn without a call' END AS reason
FROM o WHERE (role = 'assistant' AND contains(text, '<|channel|>final<|message|>')) OR (role = 'assistant' AND tool_name IS NOT NULL AND text <> '' AND thinking <> '') OR (role = 'tool' AND is_open = 0)""",
)
def invalid_turns(s, d):
    return C.invalid_turns(talk(s, d))


@query("parsed_special_tokens", "SELECT DISTINCT source || '_token' AS kind, '<|' || source || '|>' AS token, 'first' AS generation FROM documents WHERE source IS NOT NULL")
def parsed_special_tokens(s, d):
    """A map from kinds to tokens, every second one as an object, as the sources of the table give it."""
    path = scratch(s, "special")
    names = table(s, d, "documents").where("source is not null").select("source").distinct()
    token = F.concat(F.lit("<|"), "source", F.lit("|>"))
    value = F.when(F.length("source") % 2 == 0, F.to_json(F.struct(token.alias("content"), F.lit(False).alias("lstrip")))).otherwise(F.concat(F.lit('"'), token, F.lit('"')))
    pairs = names.select(F.concat(F.lit('"'), "source", F.lit('_token": '), value).alias("p"))
    pairs.agg(F.concat(F.lit("{"), F.array_join(F.collect_list("p"), ", "), F.lit("}")).alias("value")).write.text(path)  # a row per source
    return C.parsed_special_tokens(s, path, "first")


# --- recipes -----------------------------------------------------------------------------------


@query("recipe_merged_vocabulary")
def recipe_merged_vocabulary(s, d):
    return recipes.merged_vocabulary(table(s, d, "documents"), 3000, ["de", "en", "es", "fr"], 4)


@query("recipe_seeded_vocabulary")
def recipe_seeded_vocabulary(s, d):
    docs = corpus.document_lines(table(s, d, "documents"))
    return rounded(recipes.seeded_vocabulary(docs.select("text"), bench_words(s, d).distinct(), 4000))


EVALUATED = SUB.replace("doc_id, lang, ", "item_id, ").replace("FROM documents", "FROM benchmark")


@query(
    "recipe_evaluation",
    f"WITH RECURSIVE {VOC}, ev AS (WITH RECURSIVE {EVALUATED}, {edges_sql('voc')}, {paths_sql()} SELECT ids, weight FROM best), c AS (SELECT token_id, CAST(sum(weight) AS BIGINT) AS n FROM (SELECT unnest(ids) AS token_id, weight FROM ev) GROUP BY 1),"
    f" v AS (SELECT n, theta, token = '{UNK}' AS u FROM c JOIN voc USING (token_id)) SELECT CAST(sum(n) AS BIGINT) AS n_tokens, CAST(coalesce(sum(n) FILTER (NOT u), 0) AS BIGINT) AS n_kept, CAST(coalesce(sum(n) FILTER (u), 0) AS BIGINT) AS n_unk, count(*) AS n_types,"
    " round(exp(-(sum(n * ln(theta)) FILTER (NOT u)) / (sum(n) FILTER (NOT u))), 4) AS ppl_model, round(exp(ln(sum(n) FILTER (NOT u)) - (sum(n * ln(n)) FILTER (NOT u)) / (sum(n) FILTER (NOT u))), 4) AS ppl_new FROM v",
)
def recipe_evaluation(s, d):
    out = recipes.evaluation(table(s, d, "benchmark"), vocab(s, d).drop("lp"), "item_id", TICKS)
    return out.withColumns({c: F.round(c, 4) for c in ("ppl_model", "ppl_new")})
