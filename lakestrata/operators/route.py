"""Keyword routing of messages to labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and their keywords, in the order that settles ties.
INTENT_KEYWORDS = {
    "sql_query": (
        "查询", "统计", "分析", "SQL", "数据", "多少", "金额", "数量", "汇总", "报表", "购买", "消费", "订单",
        "销售", "月度", "查", "看", "计算", "排名", "对比",
    ),
    "ddl_build": (
        "建表", "DDL", "数仓", "创建表", "ETL", "ODS", "DWD", "DWS", "ADS", "生成表", "分层", "维度", "事实表",
        "宽表", "汇总表", "目标表", "源表", "字段设计",
    ),
    "data_governance": (
        "冗余", "重复", "治理", "重叠", "合并", "清理", "归档", "废弃", "冗余表", "对比表", "哪些表重复", "表太多",
        "优化表", "整理",
    ),
}


def hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the lower-cased text contains; keywords are compared as written."""
    lowered = F.lower(text)
    total = F.lit(0)
    for k in keywords:
        total = total + lowered.contains(k).cast("int")
    return total


def route(messages: DataFrame, text: str, labels: Mapping[str, Sequence[str]] = INTENT_KEYWORDS) -> DataFrame:
    """Add ``label`` and ``score``: most keyword hits, first label on a tie, ``unknown`` without a hit.

    The keywords are part of the plan as literals, so there is no join and no shuffle.
    """
    counted = messages.select("*", *[hits(F.col(text), words).alias(f"_h_{label}") for label, words in labels.items()])
    best = F.greatest(F.lit(0), *[F.col(f"_h_{label}") for label in labels])
    chosen = F.when(best == 0, "unknown")
    for label in labels:
        chosen = chosen.when(F.col(f"_h_{label}") == best, label)
    return counted.select(*messages.columns, chosen.alias("label"), best.cast("long").alias("score"))
