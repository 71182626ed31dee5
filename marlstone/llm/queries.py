"""The operators' queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import ann, conversations, fingerprints, html_extract, jaccard_join, lm, packing, quality, secrets, sentencepieces, toxicity, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.query,
        "op2_toxicity": toxicity.query,
        "op3_jaccard_join": jaccard_join.query,
        "op4_sentencepieces": sentencepieces.query,
        "op5_quality": quality.query,
        "op6_secrets": secrets.query,
        "op7_html": html_extract.query,
        "op8_packing": packing.query,
        "op9_lm": lm.query,
        "op10_warc": warc.query,
        "op11_whitening": whitening.query,
        "op12_ann": ann.query,
        "op13_conversations": conversations.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": quality.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL}
