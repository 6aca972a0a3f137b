"""Package versions as sortable keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY_TYPE = "array<struct<kind:int,size:int,text:string>>"
# Parts of a key by order. Marks are below numbers, so that 1 < 1.0.1, and a pre-release comes
# before its release.
PRE, RELEASE, CORE, PRE_NUMBER, PRE_WORD = range(5)


def _number(kind: int, digits: Column) -> Column:
    """A number of any length: without leading zeros, the longer one is the larger."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.struct(
        F.lit(kind).alias("kind"), F.length(bare).alias("size"), bare.alias("text")
    )


def _mark(kind: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("size"), F.lit("").alias("text"))


def version_key(version: Column) -> Column:
    """`array<struct<kind, size, text>>` that sorts as versions do.

    All numeric parts count, of any length; zeros at the end do not, so 1.2 equals 1.2.0. A
    pre-release is below its release; its fields compare as numbers or words, numbers first. Build
    data after `+` is left out. Range marks in front are dropped; NULL comes back for text without
    a leading number (`*`, `latest`, a git URL).
    """
    bare = F.regexp_replace(version, r"^[\s^~>=<v]+", "")
    core = F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    pre = F.regexp_extract(bare, r"^[0-9]+(?:\.[0-9]+)*-([0-9A-Za-z.-]+)", 1)
    trimmed = F.regexp_replace(core, r"^0+(?:\.0+)*$|(?:\.0+)+$", "")
    parts = lambda text: F.filter(F.split(text, r"\."), lambda x: x != "")
    numbers = F.transform(parts(trimmed), lambda x: _number(CORE, x))
    field = lambda x: F.when(x.rlike("^[0-9]+$"), _number(PRE_NUMBER, x)).otherwise(
        F.struct(F.lit(PRE_WORD).alias("kind"), F.lit(0).alias("size"), x.alias("text"))
    )
    end = F.when(
        pre != "", F.concat(F.array(_mark(PRE)), F.transform(parts(pre), field))
    ).otherwise(F.array(_mark(RELEASE)))
    return F.when(core != "", F.concat(numbers, end).cast(KEY_TYPE))


def range_keys(text: Column) -> Column:
    """Keys of the lowest versions that the alternatives of a range allow.

    `a || b` has one for each side. Of several comparators the first that is no upper bound counts;
    upper bounds alone start at 0. `workspace:` and `npm:name@` in front are dropped. Alternatives
    without a number give nothing; the array may be empty.
    """
    plain = F.regexp_replace(text, r"^\s*(?:workspace:|npm:@?[^@]*@)", "")
    sides = F.split(plain, r"\|\|")

    def lowest(side: Column) -> Column:
        # "< 2" and "<2" are one comparator.
        joined = F.regexp_replace(F.trim(side), r"([<>=^~]+)\s+", "$1")
        lower = F.filter(F.split(joined, r"\s+"), lambda c: ~c.startswith("<"))
        return F.when(
            joined.startswith("<") & (F.size(lower) == 0), version_key(F.lit("0"))
        ).otherwise(version_key(F.get(lower, F.lit(0))))

    return F.array_compact(F.transform(sides, lowest))


def package_name(name: Column, text: Column) -> Column:
    """The package that a dependency stands for: that of an `npm:` alias, else its own name."""
    alias = F.regexp_extract(text, r"^\s*npm:(@?[^@]+)(?:@|$)", 1)
    return F.when(alias != "", alias).otherwise(name)
