"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {"op1_sstable": "sstable", "op2_quality_rules": "quality", "op3_decontaminate": "decontaminate", "op4_byte_bpe": "byte_bpe", "op5_chat": "chat", "op6_html": "html_text", "op7_warc": "warc", "op8_pitman_yor": "pitman_yor", "op10_minhash": "minhash", "op9_substrings": "substrings"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from .sql import all_sql

    return all_sql()
