"""Pages with what the local rules make of them, worked out by hand: ({n} stands for the doc_id) url, title, snippets, and
the rows that come out as (index, part, kept, reason, route, actions, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffsieve.operators import local_rules
from chaffsieve.plans import base as B
from chaffsieve.plans.registry import query

_OUTLINE = (
    '{"mainEntity":{"text":"Intro\\nPart one\\nPart two\\nPart three\\nPart four\\nPart five\\nPart six\\nEnd {n}","headline":"Page {n}"},"headline":"Page {n}"}'
)
_REPO, _PULL, _RELEASE = "https://github.com/acme/tool", "https://github.com/acme/tool/pull/{n}", "https://github.com/acme/tool/releases/tag/v1"
_POST, _STATUS, _OTHER = "https://dev.to/ann/post-{n}", "https://x.com/ann/status/{n}", "https://example.com/{n}"
CASES = (
    # An outline of which two sections have text of their own in other snippets goes; with one such section it is converted.
    (_POST, "Page {n} - DEV Community", (_OUTLINE, "## Part one\nbody of one", "### Part two\n\nbody of two"), (
        (0, None, False, "boilerplate", None, "devto:article_outline:0", _OUTLINE),
        (1, None, True, None, "not_json", "", "## Part one\nbody of one"),
        (2, None, True, None, "not_json", "", "### Part two\n\nbody of two"))),
    (_POST, "Page {n} - DEV Community", (_OUTLINE, "## Part one\nbody of one", "### Part two\n> quoted only"), (
        (0, 0, True, None, "converted", "", "Page {n}"),
        (1, None, True, None, "not_json", "", "## Part one\nbody of one"),
        (2, None, True, None, "not_json", "", "### Part two\n> quoted only"))),
    # A description that an earlier snippet holds at word bounds goes, one within a longer word stays.
    (_REPO, "tool", ("Tool {n} is a small and quick parser. More text", "## About\n\nTool {n} is a small and quick parser."), (
        (0, None, True, None, "not_json", "", "Tool {n} is a small and quick parser. More text"),
        (1, None, False, "dup", "not_json", "github:about_echo:1,github:about_echo:3", "## About\n\nTool {n} is a small and quick parser."))),
    (_REPO, "tool", ("xTool {n} is a small and quick parser.", "## About\n\nTool {n} is a small and quick parser."), (
        (0, None, True, None, "not_json", "", "xTool {n} is a small and quick parser."),
        (1, None, True, None, "not_json", "", "## About\n\nTool {n} is a small and quick parser."))),
    (_REPO, "tool", ("## About\n## Topics\npython spark sql-{n}",), (
        (0, None, False, "boilerplate", "not_json", "github:repo_topics:1,github:repo_topics:2,github:repo_topics:3", "## About\n## Topics\npython spark sql-{n}"),)),
    # The prompt and its answer are a pair across blank lines only.
    (_RELEASE, "v1", ("Choose a tag to compare\n\n   \nNo results found\nrest {n}",), (
        (0, None, True, None, "not_json", "github:tag_compare:1,github:tag_compare:4", "rest {n}"),)),
    (_RELEASE, "v1", ("Choose a tag to compare\ntext {n}\nNo results found",), (
        (0, None, True, None, "not_json", "", "Choose a tag to compare\ntext {n}\nNo results found"),)),
    (_STATUS, "status", ("Log in or sign up for X\nRelevant people\nrest {n}",), (
        (0, None, True, None, "not_json", "x:auth_sidebar_card:1,x:auth_sidebar_card:2", "rest {n}"),)),
    # Structured data: every key known and the headline the title's; an unknown key; a question with its answer.
    (_OTHER, "Page {n}", ('{"@type":"Thing","author":"x","headline":"Page {n}"}', '[{"@type":"Thing"},{"unknown":{n}}]'), (
        (0, None, False, "jsonld_meta", "dropped_meta", "", '{"@type":"Thing","author":"x","headline":"Page {n}"}'),
        (1, None, True, None, "kept_raw", "", '[{"@type":"Thing"},{"unknown":{n}}]'))),
    (_OTHER, "Page {n}", ('{"mainEntity":[{"name":"Why {n}?","acceptedAnswer":{"text":"Because."}},{"acceptedAnswer":{"text":" "}}]}', "[{n}", "{n}"), (
        (0, 0, True, None, "converted", "", "Q: Why {n}?\nA: Because."),
        (1, None, True, None, "not_json", "", "[{n}"),
        (2, None, True, None, "not_json", "", "{n}"))),
    # Nothing goes from code or quotations, nor from what continues a quotation.
    (_STATUS, "status", ("```\nShow more\n```\nfree {n}\nShow more",), (
        (0, None, True, None, "not_json", "x:show_more_button:5", "```\nShow more\n```\nfree {n}"),)),
    (_REPO, "tool", ("> Repository files navigation\nRepository files navigation\n\nfree {n}\nRepository files navigation",), (
        (0, None, True, None, "not_json", "github:repo_nav:5", "> Repository files navigation\nRepository files navigation\n\nfree {n}"),)),
    # A branch of this repository, and one of another.
    (_PULL, "pull", ("see acme/tool:fix-{n} Copy head branch name to clipboard", "acme/tool2:fix-{n} Copy head branch name to clipboard"), (
        (0, None, True, None, "not_json", "github:copy_branch_button:1", "see acme/tool:fix-{n}"),
        (1, None, True, None, "not_json", "", "acme/tool2:fix-{n} Copy head branch name to clipboard"))),
)


def _lit(v: object) -> str:
    return "NULL" if v is None else B.quoted(v) if isinstance(v, str) else str(v)


_ROWS = ", ".join(
    "(" + ", ".join(map(_lit, (k, *row))) + ")" for k, (_, _, _, rows) in enumerate(CASES) for row in rows
)


@query(
    "w04_w07_w08_j07_j08_a14_u07_page_cases",
    f"""WITH made(k, index, part, kept, reason, route, actions, text) AS (VALUES {_ROWS})
SELECT doc_id, index, part, kept, reason, route, actions, sha256(replace(made.text, '{{n}}', CAST(doc_id AS VARCHAR))) AS text_sha256
FROM documents JOIN made ON k = doc_id % {len(CASES)}""",
)
def page_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(values: list):
        return F.get(F.array(*values), (F.col("doc_id") % len(CASES)).cast("int"))

    filled = lambda c: F.replace(c, F.lit("{n}"), F.col("doc_id").cast("string"))
    docs = B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.lit(0).cast("long").alias("source_index"),
        filled(pick([F.lit(url) for url, _, _, _ in CASES])).alias("url"), filled(pick([F.lit(title) for _, title, _, _ in CASES])).alias("title"),
        F.transform(pick([F.array(*map(F.lit, snippets)) for _, _, snippets, _ in CASES]), filled).alias("snippets"),
    )
    said = F.transform("actions", lambda a: F.concat_ws(":", a["cleaner"], a["rule"], a["line"].cast("string")))
    return local_rules.applied(docs).select(
        F.col("request_id").alias("doc_id"), "index", "part", "kept", "reason", "route",
        F.array_join(said, ",").alias("actions"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
