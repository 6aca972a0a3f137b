from lintlake.sources.files import (
    exclude_globs, exclude_tests, explode_lines, extract_deps, extract_imports,
    extract_named_imports, file_stats, filter_extensions, parse_manifest, read_files,
    select_sources, select_templates, select_test_files, select_tests_wide, walk_condition,
)
from lintlake.sources.sinks import read_issues, write_issues, write_report_json

__all__ = [
    "exclude_globs", "exclude_tests", "explode_lines", "extract_deps", "extract_imports",
    "extract_named_imports", "file_stats", "filter_extensions", "parse_manifest", "read_files",
    "read_issues", "select_sources", "select_templates", "select_test_files",
    "select_tests_wide", "walk_condition", "write_issues", "write_report_json",
]
