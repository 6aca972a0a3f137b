"""Shared names: categories, severities and the issue row."""

from __future__ import annotations

# Category order decides report order and the order of the weighted sum.
CATEGORIES = ("quality", "security", "performance", "accessibility", "testing", "architecture")

# Report rank of a severity; anything else ranks after "info".
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}

# Points one issue costs its category.
PENALTIES = {
    "quality": {"critical": 15.0, "high": 8.0, "medium": 3.0, "low": 1.0, "info": 0.5},
    "security": {"critical": 20.0, "high": 12.0, "medium": 5.0, "low": 2.0, "info": 0.0},
    "performance": {"critical": 15.0, "high": 8.0, "medium": 4.0, "low": 1.0, "info": 0.0},
    "accessibility": {"critical": 15.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.0},
    "testing": {"critical": 25.0, "high": 10.0, "medium": 4.0, "low": 1.0, "info": 0.0},
    "architecture": {"critical": 20.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.0},
}

# Weights used by a full audit, and those used when none are configured.
AUDIT_WEIGHTS = {
    "quality": 0.2,
    "security": 0.25,
    "performance": 0.2,
    "accessibility": 0.1,
    "testing": 0.15,
    "architecture": 0.1,
}
BARE_WEIGHTS = {
    "quality": 0.1667,
    "security": 0.1667,
    "performance": 0.1667,
    "accessibility": 0.1667,
    "testing": 0.1667,
    "architecture": 0.1665,
}

FILES_SCHEMA = "repo_id string, path string, content string, mtime timestamp"

ORD_TYPE = "struct<cat:int,phase:int,path:string,grp:int,k1:int,k2:int>"
FIX_TYPE = "struct<description:string,before:string,after:string,automated:boolean>"

ISSUE_SCHEMA = (
    "repo_id string, id string, category string, severity string, title string, "
    "description string, file string, line int, rule string, "
    f"fix {FIX_TYPE}, tags array<string>, effort string, impact string, "
    f"references array<string>, ord {ORD_TYPE}"
)
ISSUE_COLUMNS = (
    "repo_id", "id", "category", "severity", "title", "description", "file", "line",
    "rule", "fix", "tags", "effort", "impact", "references", "ord",
)
