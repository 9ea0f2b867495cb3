"""Findings with ordered evidence paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.functions.identity import digest16
from graphweave.functions.patterns import glob_column, severity_name


def path_text(steps: Column) -> Column:
    """A path as text: ``role:file:line`` of every step."""
    return F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["role"], s["file"], s["line"].cast("string"))), " > ")


def ranked_paths(paths: DataFrame) -> DataFrame:
    """Distinct paths with what they are ranked by: ``rule, file, line, order, steps``; ``order`` is (doubt, length, text), the least first.

    ``paths`` has ``rule`` and ``steps``: an array of structs of role, file, line, snippet, note and confidence in hundredths. A path's confidence is its least step's; a path
    is known by role, file and line of its steps, and of equal ones that of the greatest confidence counts. Paths without steps are dropped. The last step is the sink; ``paths`` may have its
    ``file`` and ``line`` beside the steps, so that rows which already lie by them stay where they are.
    """
    some = paths.where(F.size("steps") > 0)
    sure = F.array_min(F.transform("steps", lambda s: F.coalesce(s["confidence"], F.lit(100))))
    order = F.struct((-sure).alias("doubt"), F.size("steps").alias("length"), path_text(F.col("steps")).alias("text"))
    sink = ["file", "line"] if {"file", "line"} <= set(paths.columns) else [F.element_at("steps", -1)[c].alias(c) for c in ("file", "line")]
    rows = some.select("rule", *sink, order.alias("order"), "steps")
    first = rows.groupBy("rule", "file", "line", F.col("order.text").alias("text")).agg(F.min(F.struct("order", "steps")).alias("p"))
    return first.select("rule", "file", "line", "p.order", "p.steps")


#: Entry kinds that a step's field ``entry`` names.
CONSOLE, HTTP, UNAUTHENTICATED = "console", "http", "unauthenticated"


def _entry_kinds(ranked: DataFrame) -> tuple[Column, Column, Column]:
    """Whether a path begins at an entry point, at one over HTTP, at an unauthenticated one: by the field ``entry`` of its steps where they have it, else by the note."""
    entry = F.element_at("steps", 1)
    is_entry = entry["role"] == "entry"
    if "entry" in ranked.schema["steps"].dataType.elementType.names:
        kind = F.coalesce(entry["entry"], F.lit(""))
        return is_entry & (kind != ""), is_entry & kind.isin(HTTP, UNAUTHENTICATED), is_entry & (kind == UNAUTHENTICATED)
    note = F.coalesce(entry["note"], F.lit(""))
    return is_entry & note.endswith("entry point"), is_entry & note.startswith("HTTP"), is_entry & note.contains("unauthenticated")


def without_globs(findings: DataFrame, globs: DataFrame, as_of: Column) -> DataFrame:
    """``findings`` less those that a suppression of their rule covers: ``globs`` (few, from a configuration) has ``rule, pattern, expires``; one without expiry, or not yet past it on the day ``as_of``, counts."""
    active = globs.where(F.col("expires").isNull() | (as_of <= F.col("expires"))).select(F.col("rule").alias("_rule"), glob_column(F.col("pattern")).alias("_regex"))
    covers = (F.col("rule") == F.col("_rule")) & F.rlike(F.coalesce("file", F.lit("")), F.col("_regex"))
    return findings.join(active, covers, "left_anti")


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """``findings`` less those whose fingerprint is in ``baseline``."""
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def bare_ignores(bare: DataFrame, rule: str, severity: int) -> DataFrame:
    """Findings (as ``assemble`` gives them) of ignore comments that name no rule: ``bare`` has ``file, line, snippet``; nothing suppresses them."""
    step = F.struct(F.lit("entry").alias("role"), "file", "line", "snippet")
    return bare.select(
        digest16(F.lit(rule), F.col("file"), F.col("line"), path_text(F.array(step))).alias("id"), digest16(F.lit(rule), F.col("file"), F.concat(F.lit("entry:"), F.coalesce("snippet", F.lit("")))).alias("fingerprint"), F.lit(rule).alias("rule"), "file", "line",
        severity_name(F.lit(severity)).alias("severity"), F.lit(False).alias("needs_review"), F.lit(100).alias("confidence"), F.lit(0).cast("long").alias("alternatives"), F.array(step).alias("steps"),
    ).distinct()


def sinks(ranked: DataFrame) -> DataFrame:
    """Per rule and sink what ``findings`` asks for: ``rule, file, line, has_entry, has_http, open, alternatives, p``; ``p`` is the primary path (``order, steps``).

    Only sums, flags and the least path of a group meet in one task, never its paths.
    """
    has_entry, has_http, unauthenticated = _entry_kinds(ranked)
    return ranked.groupBy("rule", "file", "line").agg(
        F.bool_or(has_entry).alias("has_entry"), F.bool_or(has_http).alias("has_http"), F.bool_or(unauthenticated).alias("open"),
        (F.count("*") - 1).alias("alternatives"), F.min(F.struct("order", "steps")).alias("p"),
    )


def assemble(ranked: DataFrame, rules: DataFrame, suppressed: DataFrame, baseline: DataFrame | None, unsure_under: int = 50, globs: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """``findings`` of the sinks of ranked paths."""
    return findings(sinks(ranked), rules, suppressed, baseline, unsure_under, globs, as_of)


def findings(found: DataFrame, rules: DataFrame, suppressed: DataFrame, baseline: DataFrame | None, unsure_under: int = 50, globs: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """One finding per rule and sink: ``id, fingerprint, rule, file, line, severity, needs_review, confidence, alternatives, steps`` (the primary path).

    In this order: unknown rules go; taint findings rise a step if an entry is unauthenticated HTTP, else fall one if there are entries and none is HTTP; the first path in order
    is primary; findings whose sink lies in ``vendor/`` go; a step less sure than ``unsure_under`` on the primary path takes a step more and asks for review; findings suppressed on
    the line above (``suppressed``: ``file, rule, line``) go, then those that ``globs`` cover on the day ``as_of`` (see ``without_globs``), then those whose fingerprint is in ``baseline``.
    ``found`` is as ``sinks`` gives it; ``rules`` has ``rule, kind`` (taint or structural) ``, rank``.
    """
    known = found.join(rules, "rule").where(~F.coalesce(F.col("file").contains("vendor/"), F.lit(False)))
    taint = F.col("kind") == "taint"
    moved = F.when(taint & F.col("open"), 1).when(taint & F.col("has_entry") & ~F.col("has_http"), -1).otherwise(0)
    raised = F.greatest(F.lit(0), F.least(F.lit(4), F.col("rank") + moved))
    unsure = taint & (-F.col("p.order.doubt") < unsure_under)
    steps = F.col("p.steps")
    shown = known.select(
        digest16(F.col("rule"), F.col("file"), F.col("line"), path_text(steps)).alias("id"),
        digest16(F.col("rule"), F.col("file"), F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["role"], F.coalesce(s["snippet"], F.lit("")))), " > ")).alias("fingerprint"),
        "rule", "file", "line", severity_name(raised - F.when(unsure, 1).otherwise(0)).alias("severity"), F.coalesce(unsure, F.lit(False)).alias("needs_review"),
        (-F.col("p.order.doubt")).cast("int").alias("confidence"), "alternatives", steps.alias("steps"),
    )
    above = suppressed.select("file", "rule", (F.col("line") + 1).alias("line")).distinct()
    shown = shown.join(above, ["file", "rule", "line"], "left_anti")
    if globs is not None:
        shown = without_globs(shown, globs, F.current_date() if as_of is None else as_of)
    return shown if baseline is None else without_baseline(shown, baseline)
