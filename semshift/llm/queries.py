"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import caps, codes, images, middle, mixing, pieces, private, quality, records, shards, simhash, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_images": images.op1_images,
        "op2_shards": shards.op2_shards,
        "op3_records": records.op3_records,
        "op4_mixing": mixing.op4_mixing,
        "op5_simhash": simhash.op5_simhash,
        "op6_substring": substring.op6_substring,
        "op7_pieces": pieces.op7_pieces,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_quality": quality.op9_quality,
        "op10_caps": caps.op10_caps,
        "op11_private": private.op11_private,
        "op12_codes": codes.op12_codes,
        "op13_middle": middle.op13_middle,
    }


def oracle_sql() -> dict[str, str]:
    """SQL expresses the windows of op6; the other operators are tested against brute force, exact round trips or held-out labels."""
    return {"op6_substring": substring.ORACLE_SQL}
