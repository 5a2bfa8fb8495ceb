"""What the registered queries share: tables, the vocabulary counted from ``documents``, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.patterns import UNK
from lexiforge.operators import ngrams
from lexiforge.operators.train import checkpointed

MAX_LENGTH, MIN_FREQ = 4, 30
MARKERS = {m: i for i, m in enumerate(("<|start|>", "<|channel|>", "<|constrain|>", "<|message|>", "<|end|>", "<|return|>", "<|call|>"))}


TEXTS = ("documents", "pages")


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table; texts in fewer file splits than there are cores are dealt out first (many files are read where they are)."""
    df, cores = s.read.parquet(f"{d}/{name}.parquet"), s.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def segments(s: SparkSession, d: str) -> DataFrame:
    return ngrams.to_segments(table(s, d, "documents"))


def grams(s: SparkSession, d: str) -> DataFrame:
    return ngrams.count_ngrams(segments(s, d), MAX_LENGTH)


def seeds(s: SparkSession, d: str) -> DataFrame:
    return ngrams.seed_vocab(grams(s, d), MIN_FREQ).withColumn("freq", F.greatest("freq", F.lit(1)))


def vocab(s: SparkSession, d: str) -> DataFrame:
    """(token_id, token, freq, theta, lp): lp is ln(theta) in millionths, a whole number, so that sums are exact."""
    named = checkpointed(ngrams.index_vocab(checkpointed(seeds(s, d))))  # numbering reads its input twice
    out = ngrams.normalized(named, "freq")
    return checkpointed(out.withColumn("lp", F.round(F.log("theta") * 1e6)))


def typed(s: SparkSession, d: str) -> DataFrame:
    """(pos, token, score): the vocabulary as a table with an order; the score is the frequency."""
    return vocab(s, d).select(F.col("token_id").alias("pos"), "token", F.col("freq").cast("double").alias("score"))


def scratch(s: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    checkpointed(s.range(1))
    return f"{s.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


WORDS = r"words AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM documents)"
SEG = f"{WORDS}, seg AS (SELECT '▁' || w AS seg, CAST(count(*) AS BIGINT) AS weight FROM words GROUP BY 1)"
SUB = f"""{SEG}, sub AS (SELECT seg, weight, e, l, substring(seg, e - l + 1, l) AS token FROM (SELECT seg, weight, e, unnest(range(1, least({MAX_LENGTH}, e) + 1)) AS l
  FROM (SELECT seg, weight, unnest(range(1, length(seg) + 1)) AS e FROM seg)))"""
NG = f"{SUB}, ng AS (SELECT token, CAST(sum(weight) AS BIGINT) AS freq FROM sub GROUP BY token)"
SEEDS = f"{NG}, seeds AS (SELECT token, freq FROM ng WHERE (length(token) = 1 OR freq >= {MIN_FREQ}) AND token NOT IN ('', '{UNK}') UNION ALL SELECT '{UNK}', 1)"
VOC = f"""{SEEDS}, voc AS (SELECT CAST(row_number() OVER (ORDER BY token) - 1 AS INT) AS token_id, token, freq, freq / (SELECT sum(freq) FROM seeds) AS theta,
  round(ln(freq / (SELECT sum(freq) FROM seeds)) * 1e6) AS lp FROM seeds)"""


def unit_sql(value: str) -> str:
    """SQL of ``ngrams.unit_interval`` for a text expression."""
    return f"((CAST('0x' || left(md5({value}), 13) AS BIGINT) + 0.5) / 4503599627370496)"


def edges_sql(voc: str, p: str = "", token: str = "token") -> str:
    """The lattice ``ed<p>`` under a table (token_id, token, lp)."""
    return f"""unk{p} AS (SELECT * FROM {voc} WHERE token = '{UNK}'), sx{p} AS (SELECT seg, e, l, {token} AS token FROM sub), ed{p} AS (SELECT x.seg, CAST(e AS INT) AS e, CAST(l AS INT) AS l, coalesce(v.token_id, u.token_id) AS token_id, coalesce(v.lp, u.lp) AS lp
  FROM sx{p} x LEFT JOIN {voc} v USING (token) CROSS JOIN unk{p} u WHERE v.token_id IS NOT NULL OR l = 1)"""


def paths_sql(p: str = "") -> str:
    """``best<p>``: best score and last length by position, one position a step; then the way back."""
    return f"""st{p}(seg, i, s, b, t) AS (SELECT seg, 0, [CAST(0 AS DOUBLE)], [0], [-1] FROM seg UNION ALL
  SELECT st.seg, st.i + 1, list_append(any_value(st.s), max(st.s[ed.e - ed.l + 1] + ed.lp)), list_append(any_value(st.b), first(ed.l ORDER BY st.s[ed.e - ed.l + 1] + ed.lp DESC, ed.l)),
    list_append(any_value(st.t), first(ed.token_id ORDER BY st.s[ed.e - ed.l + 1] + ed.lp DESC, ed.l)) FROM st{p} st JOIN ed{p} ed ON ed.seg = st.seg AND ed.e = st.i + 1 GROUP BY st.seg, st.i),
fin{p} AS (SELECT * FROM st{p} WHERE i = length(seg)),
bt{p}(seg, p, n, ids, pieces) AS (SELECT seg, i, 0, CAST([] AS INT[]), CAST([] AS VARCHAR[]) FROM fin{p} UNION ALL SELECT bt.seg, bt.p - fin.b[bt.p + 1], bt.n + 1, list_prepend(fin.t[bt.p + 1], bt.ids),
    list_prepend(substring(bt.seg, bt.p - fin.b[bt.p + 1] + 1, fin.b[bt.p + 1]), bt.pieces) FROM bt{p} bt JOIN fin{p} fin USING (seg) WHERE bt.p > 0),
best{p} AS (SELECT bt.seg, seg.weight, bt.n, bt.ids, bt.pieces, fin.s[length(bt.seg) + 1] AS score FROM bt{p} bt JOIN fin{p} fin USING (seg) JOIN seg ON seg.seg = bt.seg WHERE bt.p = 0)"""


def forward_sql() -> str:
    """``fa``: alpha by position in natural logarithms, over ``ed``."""
    return """al(seg, i, a) AS (SELECT seg, 0, [CAST(0 AS DOUBLE)] FROM seg UNION ALL SELECT seg, i + 1, list_append(a, m + ln(list_sum(list_transform(xs, lambda v: exp(v - m))))) FROM
  (SELECT al.seg, al.i, any_value(al.a) AS a, list(al.a[ed.e - ed.l + 1] + ed.lp) AS xs, max(al.a[ed.e - ed.l + 1] + ed.lp) AS m FROM al JOIN ed ON ed.seg = al.seg AND ed.e = al.i + 1 GROUP BY al.seg, al.i)),
fa AS (SELECT seg, a, a[i + 1] AS loglik FROM al WHERE i = length(seg))"""


def sums_sql() -> str:
    """``po``: edge posteriors; ``tot``: their sums; ``mass``: the E-step, each segment's posteriors scaled to its weight."""
    return f"""{forward_sql()}, be(seg, k, b) AS (SELECT seg, 0, [CAST(0 AS DOUBLE)] FROM seg UNION ALL SELECT seg, k + 1, list_append(b, m + ln(list_sum(list_transform(xs, lambda v: exp(v - m))))) FROM
  (SELECT be.seg, be.k, any_value(be.b) AS b, list(be.b[length(be.seg) - ed.e + 1] + ed.lp) AS xs, max(be.b[length(be.seg) - ed.e + 1] + ed.lp) AS m FROM be JOIN ed ON ed.seg = be.seg AND ed.e - ed.l = length(be.seg) - be.k - 1 GROUP BY be.seg, be.k)),
fb AS (SELECT seg, b FROM be WHERE k = length(seg)),
po AS (SELECT seg, weight, e, l, token_id, exp(a[e - l + 1] + lp + b[length(seg) - e + 1] - loglik) AS p FROM ed JOIN fa USING (seg) JOIN fb USING (seg) JOIN seg USING (seg)),
tot AS (SELECT seg, sum(p) AS t FROM po GROUP BY seg), mass AS (SELECT token_id, sum(weight * p / t) AS m FROM po JOIN tot USING (seg) GROUP BY 1)"""


def nbest_sql(n: int) -> str:
    """``nbest``: (seg, rank, score, lens), the n best paths over ``ed``; equal scores by token lengths."""
    return f"""nb(seg, i, k) AS (SELECT seg, 0, [[{{'s': CAST(0 AS DOUBLE), 'p': CAST([] AS INT[])}}]] FROM seg UNION ALL
  SELECT nb.seg, nb.i + 1, list_append(any_value(nb.k), list_reverse_sort(flatten(list(list_transform(nb.k[ed.e - ed.l + 1], lambda h: {{'s': h.s + ed.lp, 'p': list_append(h.p, ed.l)}}))))[1:{n}]) FROM nb JOIN ed ON ed.seg = nb.seg AND ed.e = nb.i + 1 GROUP BY nb.seg, nb.i),
nk AS (SELECT seg, k[i + 1] AS h FROM nb WHERE i = length(seg)), nbest AS (SELECT seg, CAST(r AS INT) AS rank, h[r].s AS score, h[r].p AS lens FROM (SELECT seg, h, unnest(range(1, len(h) + 1)) AS r FROM nk))"""


EDGES = f"{VOC}, {edges_sql('voc')}"
PATHS = f"{EDGES}, {paths_sql()}"
#: The same lattice with natural logarithms.
LN_EDGES = f"{VOC}, vn AS (SELECT token_id, token, ln(theta) AS lp FROM voc), {edges_sql('vn')}"
