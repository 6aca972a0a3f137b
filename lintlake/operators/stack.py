"""Technology stack of each repository from its manifest and its paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.text import any_of
from lintlake.sources.files import parse_manifest

# Fixed values. First match wins: primary stack, framework name, packages, implied stack.
FRAMEWORKS = (
    ("nextjs", "Next.js", ("next",), "react"),
    ("react", "React", ("react", "react-dom"), None),
    ("vue", "Vue", ("vue", "@vue/core"), None),
    ("angular", "Angular", ("@angular/core",), None),
    ("nestjs", "NestJS", ("@nestjs/core", "@nestjs/common"), "node"),
    ("express", "Express", ("express",), "node"),
    ("node", "Node.js", ("fastify", "koa", "hapi", "@hapi/hapi"), None),
)
TEST_FRAMEWORKS = (
    ("Jest", ("jest", "@jest/core", "jest-cli")),
    ("Vitest", ("vitest",)),
    ("Mocha", ("mocha",)),
    ("Testing Library", ("@testing-library/react", "@testing-library/vue")),
    ("Cypress", ("cypress",)),
    ("Playwright", ("playwright", "@playwright/test")),
)
BUILD_TOOLS = (
    ("Webpack", ("webpack", "webpack-cli")),
    ("Vite", ("vite", "@vitejs/plugin-react")),
    ("Rollup", ("rollup",)),
    ("tsup", ("tsup",)),
    ("esbuild", ("esbuild",)),
    ("Turborepo", ("turbo",)),
)


def _has(packages: tuple[str, ...]) -> Column:
    return any_of(*[F.array_contains("packages", p) for p in packages])


def _tools(groups: tuple) -> Column:
    return F.array_compact(F.array(*[F.when(_has(p), F.lit(name)) for name, p in groups]))


def with_packages(facts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Facts with the dependency names of the repository; both sides hold one row each."""
    names = F.array_union(F.map_keys("deps"), F.map_keys("dev_deps"))
    packages = manifests.select("repo_id", names.alias("packages"), "node_version")
    return facts.join(packages, "repo_id", "left").withColumn(
        "packages", F.coalesce("packages", F.array().cast("array<string>"))
    )


def detect_stack(facts: DataFrame, manifests: DataFrame) -> DataFrame:
    known = with_packages(facts, manifests)
    typescript = F.array_contains("packages", "typescript") | F.col("has_ts_files")
    pick = lambda k: F.when(
        _has(FRAMEWORKS[0][2]), F.lit(FRAMEWORKS[0][k])
    )
    primary, framework, implied = pick(0), pick(1), pick(3)
    for row in FRAMEWORKS[1:]:
        cond = _has(row[2])
        if row[0] == "node":
            cond = cond | F.col("has_server")
        primary, framework = primary.when(cond, row[0]), framework.when(cond, row[1])
        implied = implied.when(cond, F.lit(row[3]))
    tools = _tools(TEST_FRAMEWORKS)
    return known.select(
        "repo_id",
        F.coalesce(primary, F.when(typescript, "typescript").otherwise("javascript"))
        .alias("primary"),
        F.array_compact(
            F.array(implied, F.when(typescript & primary.isNotNull(), F.lit("typescript")))
        ).alias("secondary"),
        typescript.alias("has_typescript"),
        ((F.size(tools) > 0) | F.col("has_test_files")).alias("has_tests"),
        F.when(F.col("has_yarn"), "yarn").when(F.col("has_pnpm"), "pnpm")
        .when(F.col("has_bun"), "bun").otherwise("npm").alias("package_manager"),
        "node_version",
        F.array_compact(F.array(framework)).alias("frameworks"),
        tools.alias("test_frameworks"),
        _tools(BUILD_TOOLS).alias("build_tools"),
    )


def detect_test_frameworks(facts: DataFrame, manifests: DataFrame) -> DataFrame:
    return with_packages(facts, manifests).select(
        "repo_id", F.posexplode(_tools(TEST_FRAMEWORKS)).alias("pos", "tool")
    )


def detect_build_tools(facts: DataFrame, manifests: DataFrame) -> DataFrame:
    return with_packages(facts, manifests).select(
        "repo_id", F.posexplode(_tools(BUILD_TOOLS)).alias("pos", "tool")
    )


def detect_package_manager(facts: DataFrame, manifests: DataFrame) -> DataFrame:
    return detect_stack(facts, manifests).select("repo_id", "package_manager")


def stack_of(files: DataFrame, facts: DataFrame) -> DataFrame:
    return detect_stack(facts, parse_manifest(files))
