"""Review prompts built from the tables, and replies parsed into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.operators.ranking import PROMPT_ISSUES, in_order, top_k
from lintlake.schema import CATEGORIES

# Prompt texts around the data.
REVIEW_INTRO = (
    "You are an expert code reviewer and software architect. Analyze this audit report and "
    "provide actionable insights.\n\n## Project Audit Summary\n"
)
REVIEW_TASK = """

## Instructions
Please provide:
1. A 2-3 sentence overall summary of the codebase health
2. Top 5 priority actions the team should take immediately
3. For each category with a score below 70, specific actionable recommendations
4. Estimated time to fix the critical issues

Respond in JSON format:
{
  "overallSummary": "string",
  "priorityActions": ["string"],
  "insights": [
    {
      "category": "quality|security|performance|accessibility|testing|architecture",
      "summary": "string",
      "suggestions": ["string"],
      "codeExamples": [{ "before": "string", "after": "string", "explanation": "string" }]
    }
  ],
  "estimatedFixTime": "string"
}"""
SECURITY_TASK = """

For each critical issue, provide:
1. Why it's dangerous
2. Step-by-step fix
3. Code example

Be concise and actionable."""
REFACTOR_INTRO = (
    "You are a senior software engineer. Refactor this code to fix the following issue:\n\n"
    "Issue: "
)
REFACTOR_TASK = """

Provide:
1. Refactored code
2. Explanation of changes
3. Any additional improvements

Keep the same functionality, just improve the code quality."""

REPLY_TYPE = (
    "overallSummary string, priorityActions array<string>, "
    "insights array<struct<category:string,summary:string,suggestions:array<string>,"
    "codeExamples:array<struct<before:string,after:string,explanation:string>>>>, "
    "estimatedFixTime string"
)


def _place() -> Column:
    line = F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string")))
    return F.concat(F.col("file"), F.coalesce(line, F.lit("")))


def joined_lines(rows: DataFrame, line: Column) -> DataFrame:
    """One text per repository from already limited, ranked rows."""
    return rows.groupBy("repo_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))),
                        lambda x: x["t"]),
            "\n",
        ).alias("bullets")
    )


def insight_prompt(
    issues: DataFrame, scores: DataFrame, subs: DataFrame, summary: DataFrame, stack: DataFrame
) -> DataFrame:
    """Code review prompt per repository: totals, sub-scores, first twenty serious issues."""
    serious = issues.where(F.col("severity").isin("critical", "high"))
    bullet = F.concat(
        F.lit("- ["), F.upper("severity"), F.lit("] "), F.col("title"), F.lit(": "),
        F.col("description"), F.lit(" ("), _place(), F.lit(")"),
    )
    bullets = joined_lines(top_k(serious, ("repo_id",), in_order(), PROMPT_ISSUES), bullet)
    table = subs.groupBy("repo_id").agg(*[
        F.max(F.when(
            F.col("category") == c,
            F.concat(F.lit(f"- {c}: "), F.col("score").cast("string"), F.lit("/100 ("),
                     F.col("issue_count").cast("string"), F.lit(" issues)")),
        )).alias(f"l_{c}")
        for c in CATEGORIES
    ])
    text = lambda c: F.col(c).cast("string")
    prompt = F.concat(
        F.lit(REVIEW_INTRO),
        F.lit("- Overall Score: "), text("overall"), F.lit("/100 (Grade: "), F.col("grade"),
        F.lit(")\n- Total Issues: "), text("total_issues"), F.lit(" ("),
        text("critical_issues"), F.lit(" critical, "), text("high_issues"), F.lit(" high)"),
        F.lit("\n- Stack: "), F.col("primary"), F.lit(" "), F.array_join("frameworks", ", "),
        F.lit("\n\n## Sub-scores\n"), F.concat_ws("\n", *[f"l_{c}" for c in CATEGORIES]),
        F.lit("\n\n## Top Critical/High Issues\n"),
        F.coalesce("bullets", F.lit("No critical issues found.")),
        F.lit(REVIEW_TASK),
    )
    return (
        scores.join(subs_to_one(table), "repo_id")
        .join(summary, "repo_id")
        .join(stack.select("repo_id", "primary", "frameworks"), "repo_id")
        .join(bullets, "repo_id", "left")
        .select("repo_id", prompt.alias("prompt"))
    )


def subs_to_one(table: DataFrame) -> DataFrame:
    return table.select("repo_id", *[f"l_{c}" for c in CATEGORIES])


def security_prompt(issues: DataFrame, category: str = "security") -> DataFrame:
    """Remediation prompt from the first serious issues of one category."""
    rows = issues.where(
        (F.col("category") == category) & F.col("severity").isin("critical", "high")
    )
    bullet = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), _place(), F.lit(")"))
    intro = (
        f"You are a security expert. Review these {category} issues and provide remediation "
        "guidance:\n\n"
    )
    return joined_lines(top_k(rows, ("repo_id",), in_order(), PROMPT_ISSUES), bullet).select(
        "repo_id", F.concat(F.lit(intro), F.col("bullets"), F.lit(SECURITY_TASK)).alias("prompt")
    )


def refactor_prompt(issues: DataFrame) -> DataFrame:
    """Refactoring prompt per issue that quotes its code."""
    return issues.where(F.col("fix.before").isNotNull()).select(
        "repo_id", "id",
        F.concat(
            F.lit(REFACTOR_INTRO), F.col("title"), F.lit("\n\nCode:\n```\n"),
            F.col("fix.before"), F.lit("\n```"), F.lit(REFACTOR_TASK),
        ).alias("prompt"),
    )


def parse_insights(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Model replies to columns, beside the whole reply. Text that is not JSON becomes the summary,
    cut at 500; the reply itself stays in its column."""
    text = F.col(raw)
    is_json = F.try_parse_json(text).isNotNull()
    reply = F.from_json(text, REPLY_TYPE)
    return replies.withColumns({"_json": is_json, "_r": reply}).select(
        *replies.columns,
        F.when(F.col("_json"), F.coalesce("_r.overallSummary", F.lit("No summary provided.")))
        .otherwise(F.left(text, F.lit(500))).alias("overall_summary"),
        F.coalesce("_r.priorityActions", F.array().cast("array<string>"))
        .alias("priority_actions"),
        F.coalesce("_r.insights", F.array().cast(
            "array<struct<category:string,summary:string,suggestions:array<string>,"
            "codeExamples:array<struct<before:string,after:string,explanation:string>>>>"
        )).alias("insights"),
        F.coalesce("_r.estimatedFixTime", F.lit("Unknown")).alias("estimated_fix_time"),
    )


def top_insights(parsed: DataFrame, insights: int = 3, actions: int = 5) -> DataFrame:
    return parsed.withColumns({
        "insights": F.slice("insights", 1, insights),
        "priority_actions": F.slice("priority_actions", 1, actions),
    })
