from lintlake.plans.auditing import (
    Audit, audit, audit_accessibility, audit_architecture, audit_performance, audit_quality,
    audit_security, audit_testing, collect_issues, run_scanner, score_audit,
)

__all__ = [
    "Audit", "audit", "audit_accessibility", "audit_architecture", "audit_performance",
    "audit_quality", "audit_security", "audit_testing", "collect_issues", "run_scanner",
    "score_audit",
]
