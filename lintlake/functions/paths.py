"""Path helpers on repo-relative paths with `/` separators."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def dir_name(path: Column) -> Column:
    """Directory of a path, empty for files in the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty for `name`, `.name` and `name.`."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1))


def join_path(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def fold_path(path: Column) -> Column:
    """Resolve `.` and `..` steps; steps above the root stay as `..`."""
    def step(acc: Column, part: Column) -> Column:
        back_ok = (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & back_ok, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.split(path, "/", -1)
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex of one ignore glob (`**`, `*`, `?`, `{a,b}`)."""
    out, i, depth = ["^"], 0, 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out) + r"\z"
