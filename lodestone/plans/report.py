"""Reports: small result tables rendered on the driver, as HTML or Markdown."""

from __future__ import annotations

import time
from html import escape

from pyspark.sql import DataFrame

from lodestone.operators import enrichment, metrics, stats
from lodestone.plans import registry
from lodestone.plans.roles import Roles
from lodestone.sources.readers import Settings
from lodestone.sources.writers import write_report

MOST_ROWS = 500


#: What the numbers are, shown at the end of a report.
METHOD = [
    ("scope", "only queries labelled match count; others are listed"),
    ("recall", "share of matches whose first acceptable row stands at the cut-off or before it"),
    ("nDCG@10", "gain 3 for the correct row and 1 for another acceptable one"),
    ("intervals", "Wilson for shares; percentile bootstrap with hashed draws for means"),
    ("paired tests", "exact two-sided McNemar, joined on the query"),
    ("confidence", "a sigmoid of each mode's raw score, at most 0.97"),
]


def mode_seconds(roles: Roles, settings: Settings) -> DataFrame:
    """mode, seconds: the time that each mode takes to rank all queries, the first one's start-up included in none of them."""
    roles.queries.count()
    took = []
    for mode in stats.MODES:
        alone = Roles(roles.spark, roles.sf_dir, roles.parameters, roles.failing)
        start = time.monotonic()
        alone.mode(mode, settings.context and mode != "regex").write.format("noop").mode("overwrite").save()
        took.append((mode, round(time.monotonic() - start, 3)))
        alone.close()
    return roles.spark.createDataFrame(took, "mode string, seconds double")


def sections(roles: Roles, settings: Settings | None = None) -> dict[str, DataFrame]:
    """One table for each section, in the order of the report; all but the queries have one row a mode, pair, bin or class."""
    done = roles.evaluated()
    summary = metrics.mean_reciprocal_rank(done).select("mode", "mrr")
    chosen = [(k, str(v)) for k, v in vars(settings or Settings()).items()]
    return {
        "Configuration": roles.spark.createDataFrame(chosen, "setting string, value string"),
        "Summary": enrichment.executive_summary(metrics.recall(done)),
        "Recall": metrics.recall(done),
        "Exact recall": metrics.recall(done, "hit_rank_correct"),
        "Recall intervals": metrics.wilson_recall(done),
        "Ranking quality": stats.ranking_intervals(metrics.matched(done)),
        "Change between modes": stats.mode_delta(summary, "mrr"),
        "Paired tests at 1": stats.mcnemar_matrix(done, 1),
        "Paired tests at 10": stats.mcnemar_matrix(done, 10),
        "Rank distribution": metrics.rank_bins(done),
        "Classes": metrics.class_breakdown(done),
        "Field ladder": stats.ladder_steps(roles.ladder()),
        "Context": registry.context_dual_pass(roles),
        "Cost and quality": registry.latency_quality(roles).join(mode_seconds(roles, settings or Settings()), "mode", "left"),
        "Expected answers": registry.expected_answer(roles),
        "Queries": metrics.hits_misses(done),
        "Method": roles.spark.createDataFrame(METHOD, "term string, meaning string"),
    }


def _cells(table: DataFrame) -> tuple[list[str], list[list[str]], bool]:
    """Columns and at most MOST_ROWS rows as text, and whether the table has more: a page is for reading, tables are for files."""
    rows = table.limit(MOST_ROWS + 1).collect()
    return table.columns, [["" if v is None else str(v) for v in r] for r in rows[:MOST_ROWS]], len(rows) > MOST_ROWS


def markdown(tables: dict[str, DataFrame], title: str = "Evaluation") -> str:
    clean = lambda x: x.replace("|", "\\|").replace("\r", " ").replace("\n", " ")
    out = [f"# {title}"]
    for name, table in tables.items():
        columns, rows, more = _cells(table)
        out += ["", f"## {name}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
        out += [f"| {' | '.join(map(clean, r))} |" for r in rows]
        out += [f"\nOnly the first {MOST_ROWS} rows are shown."] if more else []
    return "\n".join(out) + "\n"


def html(tables: dict[str, DataFrame], title: str = "Evaluation") -> str:
    out = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, table in tables.items():
        columns, rows, more = _cells(table)
        body = "".join("<tr>" + "".join(f"<td>{escape(v)}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<h2>{escape(name)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in columns)}</tr>{body}</table>" + (f"<p>Only the first {MOST_ROWS} rows are shown.</p>" if more else ""))
    return "\n".join(out)


def write(roles: Roles, path: str, settings: Settings | None = None, title: str = "Evaluation") -> str:
    """Every section of a run in one file, HTML or Markdown as the path's ending says; returns which. What the modes share is let go afterwards."""
    try:
        tables = sections(roles, settings)
        markup = path.lower().endswith((".md", ".markdown"))
        return write_report(path, "" if markup else html(tables, title), markdown(tables, title) if markup else "")
    finally:
        roles.close()
