"""Finding, scoring and rewriting sensitive text with Spark columns."""

from .functions.rules import BUNDLED_RULES, TextRule, select_rules
from .operators.policy import with_policy, with_risk
from .operators.scan import scan, transform_text, with_findings, with_rewritten

__all__ = [
    "BUNDLED_RULES", "TextRule", "scan", "select_rules", "transform_text", "with_findings", "with_policy",
    "with_rewritten", "with_risk",
]
