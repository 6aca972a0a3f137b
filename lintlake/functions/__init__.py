from lintlake.functions.grades import grade_band, js_round, score_band, score_to_grade, severity_rank
from lintlake.functions.paths import base_name, dir_name, extension, fold_path, glob_to_regex
from lintlake.functions.text import ecma, js_trim, redact, replace_first, split_lines
from lintlake.functions.versions import version_key

__all__ = [
    "base_name", "dir_name", "ecma", "extension", "fold_path", "glob_to_regex", "grade_band",
    "js_round", "js_trim", "redact", "replace_first", "score_band", "score_to_grade",
    "severity_rank", "split_lines", "version_key",
]
