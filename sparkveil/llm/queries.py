"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, extraction, neighbours, packing, preferences, quality, sharding, simhash, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_warc": warc.op2_warc,
        "op3_shards": sharding.op3_shards,
        "op4_extract": extraction.op4_extract,
        "op5_quality": quality.op5_quality,
        "op6_preferences": preferences.op6_preferences,
        "op7_packing": packing.op7_packing,
        "op8_urls": urls.op8_urls,
        "op9_decontaminate": decontamination.op9_decontaminate,
        "op10_nearest": neighbours.op10_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE,
        "op6_preferences": preferences.ORACLE,
        "op8_urls": urls.oracle(),
        "op9_decontaminate": decontamination.ORACLE,
    }
