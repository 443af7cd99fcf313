"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alphaloom.llm import chat, decontam, dedup, language, licenses, mpeg, packing, quality, secrets, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_language_id": language.op2_language_id,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_sharding": sharding.op4_sharding,
    "op5_mpeg_audio": mpeg.op5_mpeg_audio,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_chat_format": chat.op9_chat_format,
    "op10_near_dedup": dedup.op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": decontam.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
    "op5_mpeg_audio": mpeg.ORACLE_SQL,
    "op6_secret_scan": secrets.ORACLE_SQL,
    "op8_license_scan": licenses.ORACLE_SQL,
    "op9_chat_format": chat.ORACLE_SQL,
    "op10_near_dedup": dedup.ORACLE_SQL,
}
