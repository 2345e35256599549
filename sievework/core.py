"""The facade: inspect, plan, clean, profile, validate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from .config import CleanerConfig
from .operators.clean import MissingTokenOperation
from .operators.detector import HealthReport, IssueDetector
from .operators.inspect import MissingValueInspector, Report
from .operators.profile import DatasetProfile, DatasetProfiler
from .operators.rules import RuleEngine, RuleResult
from .plans.cleaning import CleaningPlan, CleaningResult


class Cleaner:
    def __init__(self, config: CleanerConfig | None = None):
        self.config = config or CleanerConfig()

    def missing(self, df: DataFrame) -> Report:
        """Missing values, of columns from the configured threshold on."""
        return MissingValueInspector().inspect(df, threshold=self.config.missing_threshold)

    def fix_tokens(self, df: DataFrame) -> DataFrame:
        """Missing-value tokens, the configured ones among them, as missing."""
        return MissingTokenOperation(self.config.missing_value_tokens).apply(df)

    def inspect(self, df: DataFrame) -> HealthReport:
        return IssueDetector().inspect(df)

    def plan(self, report: HealthReport) -> CleaningPlan:
        return CleaningPlan.from_report(report)

    def clean(self, df: DataFrame, plan: CleaningPlan, dry_run: bool = False) -> CleaningResult:
        return plan.apply(df, dry_run)

    def profile(self, df: DataFrame) -> DatasetProfile:
        return DatasetProfiler().profile(df, self.config.quantile_accuracy)

    def validate(self, df: DataFrame, contract: dict[str, Any] | None = None, rules: Sequence[str] | None = None) -> tuple[RuleResult, ...]:
        return RuleEngine().validate_contract(df, contract) if contract is not None else RuleEngine().run(df, rules)
