"""Curation of raw measurements into an exact and a censored branch.

Input columns: entity, target, target_type, type, relation, potency, value,
units, flag, validity, duplicate, comment, confidence, assay_type and the
condition fields. All predicates are plain column comparisons, so those on
stored columns reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.scalars import bound_from_value, null_safe_not_in


@dataclass(frozen=True)
class Rules:
    # The defaults are those of the published curation protocol.
    types: tuple[str, ...] = ("Ki", "Kd", "IC50", "EC50")
    units: str = "nM"
    assay_types: tuple[str, ...] = ("B", "F")
    confidence: int = 9
    target_type: str = "SINGLE PROTEIN"
    negative_comments: tuple[str, ...] = (
        "not active", "inactive", "inconclusive", "unspecified", "not determined",
    )
    # The protocol hashes the variant but does not filter on it.
    drop_variants: bool = False

    def accepts(self) -> Column:
        keep = (
            (F.col("units") == self.units)
            & F.col("type").isin(*self.types)
            & F.col("validity").isNull()
            & (F.col("duplicate") == 0)
            & null_safe_not_in("comment", self.negative_comments)
            & (F.col("confidence") == self.confidence)
            & F.col("assay_type").isin(*self.assay_types)
            & (F.col("target_type") == self.target_type)
        )
        return keep & F.col("variant").isNull() if self.drop_variants else keep


    def exact(self) -> Column:
        return self.accepts() & F.col("potency").isNotNull() & (F.col("relation") == "=") & (F.col("flag") == 1)

    def censored(self) -> Column:
        return self.accepts() & F.col("relation").isin(">", ">=") & (F.col("value") > 0)


def curate_exact(measurements: DataFrame, rules: Rules) -> DataFrame:
    return measurements.filter(rules.exact())


def curate_censored(measurements: DataFrame, rules: Rules) -> DataFrame:
    """Records that state only that potency is weaker than a bound."""
    return measurements.filter(rules.censored()).withColumn("bound", bound_from_value("value"))
