"""Import graph: resolving specifiers to files, and cycles.

Cycles are strongly connected components. They are found with linear-size frames only: trim what
cannot lie on a cycle, spread the largest reachable name forward until stable, then walk back
from each name's owner inside its colour. No path list and no closure of pairs is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.operators.issues import entry_of
from lintlake.operators.rules import Options
from lintlake.session import cut
from lintlake.sources.files import DEFAULT_EXTENSIONS, extract_imports

# Extensions tried, in order, for a specifier without one.
TRIED = ("ts", "tsx", "js", "jsx")
_KNOWN = r"\.(?:" + "|".join(DEFAULT_EXTENSIONS) + r")\z"

GRAPH_EDGE = "repo_id string, src string, dst string"


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, _KNOWN, "")


def resolve_imports(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Import edges between existing files.

    A specifier resolves to the exact path, to its `.ts` or `.tsx` twin when it says `.js`, to
    the path with a tried extension, or to an index file of that directory, in this order.

    Files are keyed by their path without extension, so one equi-join finds all candidates: a key
    holds at most one file per extension plus the index files.
    """
    walked = options.walk(DEFAULT_EXTENSIONS)
    path = F.col("path")
    index_dir = F.regexp_extract(_stem(path), r"^(.+)/index\z", 1)
    keys = F.array(_stem(path), F.when(index_dir != "", index_dir))
    targets = (
        files.where(walked)
        .select("repo_id", F.explode(F.array_compact(keys)).alias("key"), "path")
        .groupBy("repo_id", "key")
        .agg(F.collect_set("path").alias("paths"))
    )
    dst = F.col("dst")
    has_known = dst.rlike(_KNOWN)
    tried = F.array(
        *[F.concat(dst, F.lit("." + e)) for e in TRIED],
        *[F.concat(dst, F.lit("/index." + e)) for e in TRIED],
    )
    twins = F.when(
        dst.endswith(".js"), F.array(F.concat(_stem(dst), F.lit(".ts")),
                                     F.concat(_stem(dst), F.lit(".tsx")))
    ).otherwise(F.array().cast("array<string>"))
    candidates = F.concat(F.array(dst), F.when(has_known, twins).otherwise(tried))
    return (
        extract_imports(files, walked)
        .withColumn("key", _stem(dst))
        .join(targets, ["repo_id", "key"])
        .select("repo_id", "src", F.array_intersect(candidates, F.col("paths")).alias("hits"))
        .where(F.size("hits") > 0)
        .select("repo_id", "src", F.element_at("hits", 1).alias("dst"))
        .distinct()
    )


def _nodes(edges: DataFrame, column: str, name: str = "node") -> DataFrame:
    return edges.select("repo_id", F.col(column).alias(name)).distinct()


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges until every source has an incoming and every target an outgoing edge."""
    edges = cut(edges)
    size = edges.count()
    while size:
        kept = cut(
            edges.join(_nodes(edges, "dst", "src"), ["repo_id", "src"], "left_semi")
            .join(_nodes(edges, "src", "dst"), ["repo_id", "dst"], "left_semi")
            .select("repo_id", "src", "dst")
        )
        now = kept.count()
        edges = kept
        if now == size:
            break
        size = now
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """Largest name that reaches each node, itself included."""
    colour = cut(_nodes(edges, "src").withColumn("colour", F.col("node")))
    while True:
        reached = (
            edges.join(colour.withColumnRenamed("node", "src"), ["repo_id", "src"])
            .groupBy("repo_id", F.col("dst").alias("node"))
            .agg(F.max("colour").alias("incoming"))
        )
        step = cut(
            colour.join(reached, ["repo_id", "node"], "left").select(
                "repo_id", "node",
                F.greatest("colour", "incoming").alias("colour"),
                (F.coalesce("incoming", "colour") > F.col("colour")).alias("changed"),
            )
        )
        colour = step.drop("changed")
        if step.where("changed").isEmpty():
            return colour


def _owners(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Nodes that lead back to the owner of their colour, with that colour."""
    inside = cut(
        edges.join(colour.withColumnRenamed("node", "src"), ["repo_id", "src"])
        .withColumnRenamed("colour", "c")
        .join(
            colour.select("repo_id", F.col("node").alias("dst"), F.col("colour").alias("c")),
            ["repo_id", "dst", "c"],
        )
        .select("repo_id", "src", "dst", "c")
    )
    done = cut(colour.where("node = colour"))
    front = done
    while True:
        back = (
            inside.join(
                front.select("repo_id", F.col("node").alias("dst"), F.col("colour").alias("c")),
                ["repo_id", "dst", "c"], "left_semi",
            )
            .select("repo_id", F.col("src").alias("node"), F.col("c").alias("colour"))
            .distinct()
        )
        front = cut(back.join(done, ["repo_id", "node"], "left_anti"))
        if front.isEmpty():
            return done
        done = cut(done.unionByName(front))


def strong_components(edges: DataFrame) -> DataFrame:
    """`(repo_id, label, node)` of every component that holds a cycle; label is its least node."""
    edges = cut(edges.select("repo_id", "src", "dst"))
    loops = edges.where("src = dst").select(
        "repo_id", F.col("src").alias("node"), F.col("src").alias("colour")
    )
    parts = []
    rest = _trim(edges.where("src <> dst"))
    while not rest.isEmpty():
        owned = _owners(rest, _colours(rest))
        parts.append(owned)
        gone = owned.select("repo_id", "node")
        rest = _trim(
            rest.join(gone.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_anti")
            .join(gone.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_anti")
        )
    members = loops.limit(0)
    for part in parts:
        members = members.unionByName(part)
    sizes = members.groupBy("repo_id", "colour").agg(
        F.min("node").alias("label"), F.count("*").alias("members")
    )
    big = (
        members.join(sizes.where("members > 1"), ["repo_id", "colour"])
        .select("repo_id", "label", "node", "members")
    )
    single = loops.join(big, ["repo_id", "node"], "left_anti").select(
        "repo_id", F.col("node").alias("label"), "node", F.lit(1).cast("bigint").alias("members")
    )
    return big.unionByName(single)


def cycle_evidence(edges: DataFrame) -> DataFrame:
    """One finding per component, placed at its least file."""
    edges = cut(edges)
    members = cut(strong_components(edges))
    heads = members.where("node = label").select("repo_id", "label", "members")
    inside = members.select("repo_id", F.col("node").alias("dst"), F.col("label"))
    nexts = (
        edges.join(heads.select("repo_id", F.col("label").alias("src")), ["repo_id", "src"],
                   "left_semi")
        .join(inside, ["repo_id", "dst"])
        .where("label = src")
        .groupBy("repo_id", "label")
        .agg(
            F.min("dst").alias("loop"),
            F.min(F.when(F.col("dst") != F.col("label"), F.col("dst"))).alias("next"),
        )
    )
    label, follow = F.col("label"), F.coalesce("next", "loop")
    tail = (
        F.when(F.col("members") == 1, F.lit(""))
        .when(F.col("members") == 2, F.concat(F.lit(" → "), label))
        .otherwise(F.format_string(" → … (%d files)", F.col("members")))
    )
    return heads.join(nexts, ["repo_id", "label"]).select(
        "repo_id", label.alias("path"), entry_of("no-circular-dependencies").alias("entry"),
        F.concat(label, F.lit(" → "), follow, tail).alias("name"), F.col("members").alias("n"),
    )


def import_cycles(files: DataFrame, options: Options = Options()) -> DataFrame:
    return cycle_evidence(resolve_imports(files, options))
