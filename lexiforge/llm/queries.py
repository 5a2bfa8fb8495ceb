"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import chats, gif, html, licenses, mixing, ngram_join, packing, quality, runs, toxicity, tries, urls, warc
from lexiforge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_gif": lambda s, d: gif.op1_gif(table(s, d, "documents")),
        "op2_url_filter": lambda s, d: urls.op2_url_filter(table(s, d, "pages")),
        "op7_toxicity": lambda s, d: toxicity.op7_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op8_warc": lambda s, d: warc.op8_warc(table(s, d, "pages")),
        "op3_license_scan": lambda s, d: licenses.op3_license_scan(table(s, d, "documents")),
        "op4_html_text": lambda s, d: html.op4_html_text(table(s, d, "pages")),
        "op5_mixing": lambda s, d: mixing.op5_mixing(table(s, d, "documents")),
        "op6_quality_rules": lambda s, d: quality.op6_quality_rules(table(s, d, "documents")),
        "op9_ngram_jaccard": lambda s, d: ngram_join.op9_ngram_jaccard(table(s, d, "documents")),
        "op10_packing": lambda s, d: packing.op10_packing(table(s, d, "documents")),
        "op11_chat_format": lambda s, d: chats.op11_chat_format(table(s, d, "conversations")),
        "op12_periodic_runs": lambda s, d: runs.op12_periodic_runs(table(s, d, "documents")),
        "op13_prefix_trie": lambda s, d: tries.op13_prefix_trie(table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": quality.oracle(),
        "op8_warc": warc.oracle(),
        "op9_ngram_jaccard": ngram_join.oracle(),
        "op11_chat_format": chats.oracle(),
        "op12_periodic_runs": runs.oracle(),
        "op13_prefix_trie": tries.oracle(),
    }
