"""Queries of the corpus operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import ann, decontam, html_extract, langid, line_dedup, mixing, sharding, simhash, suffix_dedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": ann.op1_ann,
        "op2_html": html_extract.op2_html,
        "op3_simhash": simhash.op3_simhash,
        "op4_warc": warc.op4_warc,
        "op5_decontaminate": decontam.op5_decontaminate,
        "op6_langid": langid.op6_langid,
        "op7_sharding": sharding.op7_sharding,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_mixture": mixing.op9_mixture,
        "op10_repeats": suffix_dedup.op10_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": warc.SQL,
        "op8_line_dedup": line_dedup.SQL,
        "op9_mixture": mixing.SQL,
    }
