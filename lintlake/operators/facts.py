"""Facts per repository, taken in one path-only scan with map-side aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lintlake.functions.paths import dir_name
from lintlake.operators.rules import Options, SCOPES
from lintlake.sources.files import (
    DEFAULT_EXTENSIONS, SECURITY_EXTENSIONS, has_extension, is_test_file, is_visible,
    matches_globs,
)


def repo_facts(files: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per repository: file counts per scan and which root files exist.

    Only `path` is read. A hot repository costs one partial row per map task.
    """
    path = F.col("path")
    walked = options.walk(DEFAULT_EXTENSIONS)
    exists = lambda *names: F.bool_or(path.isin(*names))
    installed = matches_globs(("**/node_modules/**",))
    return files.groupBy("repo_id").agg(
        F.count_if(SCOPES["code"](options)).alias("n_code"),
        F.count_if(options.walk(SECURITY_EXTENSIONS)).alias("n_secure"),
        F.count_if(SCOPES["markup"](options)).alias("n_markup"),
        F.count_if(walked).alias("n_walked"),
        F.count_if(walked & dir_name(path).isin("", "src")).alias("n_flat"),
        F.count_if(is_test_file()).alias("n_tests"),
        F.bool_or(path.startswith("src/")).alias("has_src"),
        exists("README.md").alias("has_readme"),
        exists(".env").alias("has_env"),
        exists(".env.example", ".env.sample").alias("has_env_example"),
        exists("yarn.lock").alias("has_yarn"),
        exists("pnpm-lock.yaml").alias("has_pnpm"),
        exists("bun.lockb").alias("has_bun"),
        exists("server.js", "app.js").alias("has_server"),
        F.bool_or(is_visible() & has_extension(("ts", "tsx")) & ~installed).alias("has_ts_files"),
        F.bool_or(
            is_visible()
            & matches_globs(("**/*.test.*", "**/*.spec.*", "**/__tests__/**"))
            & ~installed
        ).alias("has_test_files"),
    )
