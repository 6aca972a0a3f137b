"""Audits of source-code corpora as Spark jobs."""

from lintlake.operators.rules import Options
from lintlake.plans import Audit, audit, collect_issues, run_scanner
from lintlake.session import configure

__all__ = ["Audit", "Options", "audit", "collect_issues", "configure", "run_scanner"]
__version__ = "0.1.0"
