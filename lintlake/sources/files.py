"""File tables: reading them, choosing files by path, and what is derived from one file.

Every filter here looks at `path` only, so Spark prunes `content` from a scan that does not
need it and pushes simple path filters down to Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lintlake.functions.paths import dir_name, extension, fold_path, glob_to_regex, join_path
from lintlake.functions.text import any_of, ecma, split_lines
from lintlake.schema import FILES_SCHEMA

# Extensions and ignore globs of a default walk.
DEFAULT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "vue", "mjs", "cjs")
CODE_EXTENSIONS = ("ts", "tsx", "js", "jsx")
SECURITY_EXTENSIONS = ("ts", "tsx", "js", "jsx", "json", "env", "yaml", "yml")
TEMPLATE_EXTENSIONS = ("html", "htm", "vue", "svelte")
# What any rule reads the text of: the walks above and manifests.
RULE_EXTENSIONS = tuple(dict.fromkeys((*DEFAULT_EXTENSIONS, *SECURITY_EXTENSIONS, *TEMPLATE_EXTENSIONS)))
DEFAULT_IGNORES = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/.nuxt/**",
    "**/coverage/**", "**/*.min.js", "**/*.min.css", "**/*.bundle.js", "**/.git/**",
    "**/vendor/**", "**/__pycache__/**",
)
TEST_GLOBS = ("**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/tests/**")
TEST_FILE_GLOBS = ("**/*.{test,spec}.{ts,tsx,js,jsx}",)
INSTALLED_IGNORES = ("**/node_modules/**", "**/dist/**")


@contextmanager
def _folders_listed_together(spark: SparkSession) -> Iterator[None]:
    """Within it a task lists many folders. By default one lists a folder or two, and the driver is
    busy with starting a task for each folder of a repository."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_files(
    spark: SparkSession,
    location: str,
    fmt: str = "binaryFile",
    path_glob: str | None = None,
    ignore_corrupt: bool = False,
    extensions: Sequence[str] | None = RULE_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """Load files of many repositories as rows.

    `binaryFile` expects `<location>/<repo_id>/<path...>`, a folder and no glob; each executor reads
    its own files. Bytes that are no UTF-8 become U+FFFD. Every file is a row, because rules on
    structure need its path, but only files of `extensions` (None: all) and, if given, of at most
    `max_bytes` are opened; others have a NULL content, from their listing alone. What a query does
    not ask for is not loaded either: facts on paths open no file. `path_glob` restricts the rows to
    matching names, whose contents are all loaded, and `ignore_corrupt` leaves out files that cannot
    be read. Any other format must hold the columns of `FILES_SCHEMA`.
    """
    if fmt != "binaryFile":
        return spark.read.format(fmt).schema(FILES_SCHEMA).load(location)
    if any(c in location for c in "*?[]{}"):
        raise ValueError(f"location must be a folder: {location}")
    def reader(glob: str | None) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "ignoreCorruptFiles", ignore_corrupt
        )
        with _folders_listed_together(spark):
            return (found.option("pathGlobFilter", glob) if glob else found).load(location)

    # The full path of the root, of which only the place at the front is cut.
    folder = spark._jvm.org.apache.hadoop.fs.Path(location)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(folder).toUri().getPath().rstrip("/")
    whole = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    tail = F.regexp_replace(whole, rf"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?\Q{root}\E/+", "")
    columns = lambda content: [
        F.substring_index(tail, "/", 1).alias("repo_id"),
        F.regexp_replace(tail, r"^[^/]*/", "").alias("path"),
        content.alias("content"),
        F.col("modificationTime").alias("mtime"),
    ]
    text = F.make_valid_utf8(F.col("content").cast("string"))
    # The source itself skips files by name and by length, before it opens them.
    limit = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    if path_glob or (extensions is None and max_bytes is None):
        rows = reader(path_glob)
        opened = rows.where(limit).select(*columns(text))
        named = F.lit(True)
    else:
        rows = reader(None)
        opened = reader(f"*.{{{','.join(extensions)}}}" if extensions else None).where(limit).select(*columns(text))
        named = has_extension(extensions, tail) if extensions else F.lit(True)
    if (path_glob or extensions is None) and max_bytes is None:
        return opened
    closed = rows.where(~(named & limit)).select(*columns(F.lit(None).cast("string")))
    return opened.unionByName(closed)


# ---- path conditions -------------------------------------------------------------------------


def has_extension(exts: Sequence[str], path: Column | None = None) -> Column:
    path = F.col("path") if path is None else path
    return any_of(*[path.endswith("." + e) for e in exts])


def matches_globs(globs: Sequence[str], path: Column | None = None) -> Column:
    path = F.col("path") if path is None else path
    return path.rlike("|".join(glob_to_regex(g) for g in globs))


def is_visible(path: Column | None = None) -> Column:
    """No step of the path starts with a dot."""
    path = F.col("path") if path is None else path
    return ~path.rlike(r"(?:^|/)\.")


def walk_condition(
    exts: Sequence[str] = DEFAULT_EXTENSIONS,
    ignore: Sequence[str] = (),
    tests: bool = True,
    default_ignores: Sequence[str] = DEFAULT_IGNORES,
    include_dotfiles: bool = False,
) -> Column:
    """Condition on `path` that keeps what a walk over one project keeps."""
    globs = (*default_ignores, *(() if tests else TEST_GLOBS), *ignore)
    keep = has_extension(exts)
    if not include_dotfiles:
        keep = keep & is_visible()
    return keep & ~matches_globs(globs) if globs else keep


def filter_extensions(files: DataFrame, exts: Sequence[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    return files.where(has_extension(exts))


def exclude_globs(files: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    return files.where(~matches_globs((*DEFAULT_IGNORES, *globs)))


def exclude_tests(files: DataFrame) -> DataFrame:
    return files.where(~matches_globs(TEST_GLOBS))


def select_templates(files: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    return files.where(walk_condition(TEMPLATE_EXTENSIONS, ignore))


def is_test_file() -> Column:
    return is_visible() & matches_globs(TEST_FILE_GLOBS) & ~matches_globs(INSTALLED_IGNORES)


def select_test_files(files: DataFrame) -> DataFrame:
    return files.where(is_test_file())


def select_sources(files: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Sources without tests and stories."""
    wide = tuple(g for g in DEFAULT_IGNORES if g in HELPER_IGNORES)
    globs = (*TEST_GLOBS, "**/*.stories.*", *ignore)
    return files.where(walk_condition(CODE_EXTENSIONS, globs, default_ignores=wide))


def select_tests_wide(files: DataFrame) -> DataFrame:
    """Test files by name or by a `__tests__` directory."""
    named = matches_globs((*TEST_FILE_GLOBS, "**/__tests__/**/*.{ts,tsx,js,jsx}"))
    wide = tuple(g for g in DEFAULT_IGNORES if g in HELPER_IGNORES)
    return files.where(is_visible() & named & ~matches_globs(wide))


# The shorter ignore list of the two helper selections above.
HELPER_IGNORES = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/coverage/**",
    "**/*.min.js", "**/*.bundle.js",
)


# ---- per-file derivations --------------------------------------------------------------------


def has_content(content: str = "content") -> Column:
    return F.col(content).isNotNull() & (F.col(content) != "")


def explode_lines(files: DataFrame) -> DataFrame:
    return files.where(has_content()).select(
        "repo_id", "path", F.posexplode(split_lines(F.col("content"))).alias("i", "line")
    ).select("repo_id", "path", (F.col("i") + 1).alias("line_no"), "line")


def file_stats(files: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    return files.select(
        "repo_id",
        "path",
        F.size(split_lines(content)).alias("lines"),
        F.octet_length(content).alias("bytes"),
        extension(F.col("path")).alias("ext"),
    )


MANIFEST_TYPE = (
    "dependencies map<string,string>, devDependencies map<string,string>, "
    "engines struct<node:string>"
)


def parse_manifest(files: DataFrame) -> DataFrame:
    """Root `package.json` of each repository; unparsable text gives NULL maps."""
    m = F.from_json("content", MANIFEST_TYPE)
    empty = F.create_map().cast("map<string,string>")
    return (
        files.where(F.col("path") == "package.json")
        .select("repo_id", m.alias("m"))
        .select(
            "repo_id",
            F.coalesce("m.dependencies", empty).alias("deps"),
            F.coalesce("m.devDependencies", empty).alias("dev_deps"),
            F.col("m.engines.node").alias("node_version"),
        )
    )


def extract_deps(manifests: DataFrame) -> DataFrame:
    """One row per dependency; on a name in both maps the development entry wins, and of a name that
    one map repeats the last entry."""
    only = F.map_filter("deps", lambda k, v: ~F.map_contains_key("dev_deps", k))
    entry = lambda dev: lambda e: F.struct(
        e["key"].alias("name"), e["value"].alias("range"), F.lit(dev).alias("is_dev")
    )

    def last(entries: Column) -> Column:
        """Parsed JSON keeps repeated names; they are rare, so only then is each compared."""
        names = F.transform(entries, lambda e: e["key"])
        after = lambda i: F.slice(entries, i + 2, F.size(entries))
        return F.when(F.size(F.array_distinct(names)) == F.size(names), entries).otherwise(
            F.filter(entries, lambda e, i: ~F.exists(after(i), lambda x: x["key"] == e["key"]))
        )

    rows = F.concat(
        F.transform(last(F.map_entries(only)), entry(False)),
        F.transform(last(F.map_entries("dev_deps")), entry(True)),
    )
    return manifests.select("repo_id", F.inline(rows))


# Fixed value: a relative module specifier.
RELATIVE_IMPORT = r"""from\s+['"](\.[^'"]+)['"]"""


def extract_imports(files: DataFrame, keep: Column | None = None) -> DataFrame:
    """Distinct relative imports `(repo_id, src, dst)`; `dst` is folded but not resolved to a file.

    The set is taken inside the row, so no shuffle is needed.
    """
    keep = walk_condition() if keep is None else keep
    specs = F.regexp_extract_all("content", F.lit(ecma(RELATIVE_IMPORT)), 1)
    resolved = F.transform(
        specs, lambda s: fold_path(join_path(dir_name(F.col("path")), s))
    )
    return files.where(keep & has_content() & F.col("content").contains("from")).select(
        "repo_id", F.col("path").alias("src"), F.explode(F.array_distinct(resolved)).alias("dst")
    )


# Fixed value: one import statement with named bindings.
NAMED_IMPORT = r"""import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*['"]([^'"]+)['"]"""


def extract_named_imports(files: DataFrame) -> DataFrame:
    """Module and imported name per named binding (`a as b` gives `a`)."""
    pattern = F.lit(ecma(NAMED_IMPORT))
    pairs = F.arrays_zip(
        F.regexp_extract_all("content", pattern, 1).alias("names"),
        F.regexp_extract_all("content", pattern, 2).alias("module"),
    )
    return (
        files.where(walk_condition(CODE_EXTENSIONS) & F.col("content").contains("import"))
        .select("repo_id", "path", F.inline(pairs).alias("names", "module"))
        .select("repo_id", "path", "module", F.explode(F.split("names", ",")).alias("raw"))
        .select(
            "repo_id", "path", "module",
            F.regexp_extract("raw", r"^\s*(?:type\s+)?([A-Za-z0-9_$]+)", 1).alias("name"),
        )
        .where(F.col("name") != "")
    )
