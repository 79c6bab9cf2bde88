"""Week-over-week metrics on Spark: today so far against the same part of the day a week ago."""

from weekpulse.plans.report import Report
from weekpulse.spec import ReportSpec

__all__ = ["Report", "ReportSpec"]
