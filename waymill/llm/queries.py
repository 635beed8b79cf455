"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, infill, langid, licences, neighbours, pii, planes, quality, secrets, simhash, variants, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_bpe": bpe.op2_bpe,
        "op3_licences": licences.op3_licences,
        "op4_langid": langid.op4_langid,
        "op5_decontamination": decontam.op5_decontamination,
        "op6_secrets": secrets.op6_secrets,
        "op7_quality": quality.op7_quality,
        "op8_pii": pii.op8_pii,
        "op9_warc": warc.op9_warc,
        "op10_neighbours": neighbours.op10_neighbours,
        "op11_infill": infill.op11_infill,
        "op12_variants": variants.op12_variants,
        "op13_planes": planes.op13_planes,
        "planted_neighbours": neighbours.planted_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontam.ORACLE_SQL, "op11_infill": infill.ORACLE_SQL, "op12_variants": variants.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op10_neighbours": neighbours.ORACLE_SQL, "planted_neighbours": neighbours.PLANTED_SQL}
