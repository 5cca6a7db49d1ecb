"""From raw messages to classified messages and their insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import insights as ins
from plenum.operators import messages as ms
from plenum.operators import rules
from plenum.session import cut_lineage


def classified_messages(messages: DataFrame, strict_parity: bool = False, min_length: int = 10) -> DataFrame:
    """Inbound messages, cleaned, those kept classified."""
    cleaned = ms.clean_messages(ms.inbound_only(messages), min_length=min_length)
    kept = cleaned.where("removal_reason = 'kept'").withColumn("message_text", F.col("cleaned_text")).drop("cleaned_text")
    return rules.classify(kept, strict_parity=strict_parity).withColumn("is_substantive", F.lit(True))


def issue_report(messages: DataFrame, mode: str = "respondent") -> DataFrame:
    """Insights per issue with samples and concerns.

    The classified mentions are written once: three aggregates read them.
    """
    mentions = cut_lineage(ins.mentions(classified_messages(messages)))
    return (
        ins.issue_insights(mentions, mode)
        .join(ins.sample_messages(mentions), "issue", "left")
        .join(ins.key_concerns(mentions), "issue", "left")
    )
