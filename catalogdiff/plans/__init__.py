from catalogdiff.plans.custom import custom_section, from_template
from catalogdiff.plans.report import Report, compare, write_findings
from catalogdiff.plans.sections import MAPPED_SECTIONS, SECTIONS, Comparison, Section

__all__ = [
    "MAPPED_SECTIONS",
    "SECTIONS",
    "Comparison",
    "Report",
    "Section",
    "compare",
    "custom_section",
    "from_template",
    "write_findings",
]
