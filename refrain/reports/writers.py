"""Reports: statistics are a row a format, and clones are streamed in order, all of them into files, up to a limit on a screen."""

from __future__ import annotations

import datetime
import html
import json
import os
import textwrap
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.reports import rows


def _ordered(lined: DataFrame, limit: int | None) -> DataFrame:
    own = lined.orderBy("a_id", "a_start", "b_id", "b_start", "tokens")
    return own if limit is None else own.limit(limit)


def _lines(df: DataFrame) -> Iterator[str]:
    return (r[0] for r in df.toLocalIterator())


def _between(parts: Iterator[str], mark: str) -> Iterator[str]:
    for i, x in enumerate(parts):
        yield mark + x if i else x


def detected() -> str:
    """When a report was made, in UTC."""
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def sentence(stats: DataFrame) -> str:
    t = stats.where("pool = '*'").first()
    return f"{t.clones} clones, {t.duplicated_lines} repeated lines of {t.lines} ({t.percentage:.2f}%) in {t.sources} sources" if t else "0 clones"


def compressed(a: str, b: str) -> str:
    """Two paths in one, with their common folder told once."""
    common = os.path.commonpath([os.path.dirname(a), os.path.dirname(b)]) if os.path.isabs(a) == os.path.isabs(b) else ""
    return f"{common}/{{{os.path.relpath(a, common)} ~ {os.path.relpath(b, common)}}}" if common else f"{a} ~ {b}"


def badges(stats: DataFrame) -> dict[str, str]:
    """Two pictures: the share of repeated lines, and the number of clones."""
    t = stats.where("pool = '*'").first()
    share, clones = (t.percentage, t.clones) if t else (0.0, 0)
    color = "#e05d44" if share > 20 else "#fe7d37" if share > 10 else "#4c1"
    draw = lambda text: f'<svg xmlns="http://www.w3.org/2000/svg" width="150" height="20"><rect width="150" height="20" fill="{color}"/><text x="8" y="14" fill="#fff" font-size="11">{text}</text></svg>'
    return {"share": draw(f"repeated {share:.2f}%"), "clones": draw(f"clones {clones}")}


def summary_block(files: DataFrame, folders: DataFrame, by: str) -> str:
    """The first files and folders as aligned text; shares of repeated lines are clamped to 100."""
    size = lambda n: f"{n}" if n < 1024 else f"{n / 1024:.1f}K" if n < 1024**2 else f"{n / 1024**2:.1f}M"
    share = lambda r: f"{min(100.0, 100.0 * r.duplicated_lines / r.lines):.1f}" if r.lines else "0.0"
    out = [f"Summary by {by}", "tokens lines size complexity repeated% path"]
    out += [f"{r.tokens:>8} {r.lines:>6} {size(r.bytes):>7} {r.complexity:>5} {share(r):>5} {r.path}" for r in files.collect()]
    out.append("files tokens lines size mean-complexity folder")
    return "\n".join(out + [f"{r.files:>5} {r.tokens:>8} {r.lines:>6} {size(r.bytes):>7} {r.complexity // r.files:>5} {r.folder}" for r in folders.collect()])


def pieces(kind: str, lined: DataFrame, stats: DataFrame, limit: int | None = None, cutoff: int | None = None) -> Iterator[str]:
    """The text of a report of one kind, a clone at a time: json, xml, csv, markdown, html, sarif, openmetrics, badge, ai, xcode, console, console-full, silent. ``cutoff``: SARIF results of so many tokens are errors."""
    clones = _ordered(lined, limit)
    if kind == "json":
        head = json.dumps({"detectionDate": detected(), "statistics": [r.asDict() for r in stats.orderBy("pool").collect()]}, indent=1)
        yield head[: -len("\n}")] + ',\n "duplicates": ['
        yield from _between((f"\n{textwrap.indent(json.dumps(json.loads(x), indent=1), '  ')}" for x in _lines(rows.json_duplicates(clones).select("value"))), ",")
        yield "\n ]\n}"
    elif kind == "xml":
        yield '<?xml version="1.0" encoding="utf-8"?>\n<pmd-cpd>\n'
        yield from _between(_lines(rows.xml_duplications(clones)), "\n")
        yield "\n</pmd-cpd>\n"
    elif kind == "markdown":
        head = rows.csv_rows(stats).columns
        yield "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *sorted(_lines(rows.markdown_rows(stats)))]) + "\n"
    elif kind == "csv":
        table = rows.csv_rows(stats).orderBy("Format")
        head, body = table.columns, [[str(x) for x in r] for r in table.collect()]
        yield "\n".join(",".join(r) for r in [head, *body]) + "\n"
    elif kind == "sarif":
        tool = {"driver": {"name": "refrain", "rules": [{"id": "repeated-passage"}]}}
        yield f'{{"version": "2.1.0", "runs": [{{"tool": {json.dumps(tool)}, "results": ['
        yield from _between((json.dumps(json.loads(x)) for x in _lines(rows.sarif_results(clones, cutoff or 2**31 - 1).select("result"))), ", ")
        yield '], "artifacts": ['
        yield from _between((json.dumps({"location": {"uri": x}}) for x in _lines(rows.files_of(lined))), ", ")
        yield "]}]}"
    elif kind == "openmetrics":
        out, seen = [], ""
        for line in sorted(_lines(rows.metric_lines(stats)), key=lambda x: (x.partition("{")[0].split()[0], x)):
            if (name := line.partition("{")[0].split()[0]) != seen:
                out += [f"# HELP {name} {name.removeprefix('duplication_').replace('_', ' ')}.", f"# TYPE {name} gauge"]
                seen = name
            out.append(line)
        yield "\n".join(out) + "\n# EOF\n"
    elif kind == "badge":
        yield badges(stats)["share"]
    elif kind == "html":
        groups = lined.groupBy("pool").count().orderBy("pool").collect()  # a row a format
        yield f"<!doctype html><title>Repeats</title><p>{html.escape(sentence(stats))}</p>"
        for g in groups:
            yield f"<h2>{html.escape(str(g.pool))}: {g[1]}</h2><ol>"
            yield from (f"<li>{html.escape(x)}</li>" for x in _lines(rows.compact_lines(_ordered(lined.where(F.col("pool").eqNullSafe(g.pool)), limit))))
            yield "</ol>"
    elif kind == "silent":
        yield sentence(stats)
    else:
        shown = 0
        if kind == "console-full":  # snippets of 20 lines at most, with authors where the clones have them
            texts = _snippets(clones)
        else:
            texts = _lines({"ai": rows.compact_lines, "xcode": rows.warning_lines, "console": rows.compact_lines}[kind](clones))
        for text in texts:
            yield "\n" + text if shown else text
            shown += 1
        last = [*(_table(stats) if kind == "console" else []), sentence(stats)] if kind != "ai" and kind != "xcode" else []
        if limit is not None and shown == limit and (total := lined.count()) > shown:
            last.insert(0, f"{shown} of {total} clones shown; a file report has all")
        yield "\n".join([*([""] if shown and last else []), *last])


def _table(stats: DataFrame) -> list[str]:
    """Statistics in aligned columns, a line a format, the total last."""
    table = rows.csv_rows(stats)
    body = sorted(([str(x) for x in r] for r in table.collect()), key=lambda r: (r[0] == "Total:", r[0]))
    wide = [max(len(r[i]) for r in [table.columns, *body]) for i in range(len(table.columns))]
    return ["  ".join(x.ljust(w) if not i else x.rjust(w) for i, (x, w) in enumerate(zip(r, wide, strict=True))) for r in [table.columns, *body]]


def _snippets(clones: DataFrame) -> Iterator[str]:
    for r in clones.toLocalIterator():
        r = r.asDict()
        who = f" [{r.get('a_author')} | {r.get('b_author')}]" if "a_author" in r else ""
        out = [f"{r['a_id']}:{r['a_start']}-{r['a_end']} ~ {r['b_id']}:{r['b_start']}-{r['b_end']} ({r['tokens']}){who}"]
        yield "\n".join(out + [f"  {r['a_start'] + i} | {line}" for i, line in enumerate((r.get("a_fragment") or "").split("\n")[:20])])


def report(kind: str, lined: DataFrame, stats: DataFrame, limit: int | None = 10_000, cutoff: int | None = None) -> str:
    """A report as text for a screen; clones past ``limit``, in order, are only counted there. write() has no limit."""
    screen = kind in ("console", "console-full", "ai", "xcode")
    return "".join(pieces(kind, lined, stats, limit if screen else None, cutoff))


def write(kinds: list[str], lined: DataFrame, stats: DataFrame, folder: str, cutoff: int | None = None) -> list[str]:
    """Reports as files; returns their paths."""
    suffix = {"markdown": "md", "badge": "svg", "openmetrics": "txt", "sarif": "sarif", "ai": "txt", "xcode": "txt", "console": "txt", "silent": "txt"}
    os.makedirs(folder, exist_ok=True)
    paths = []
    for kind in kinds:
        paths.append(os.path.join(folder, f"duplication-{kind}.{suffix.get(kind, kind)}"))
        with open(paths[-1], "w") as f:
            f.writelines(pieces(kind, lined, stats, cutoff=cutoff))
        if kind == "badge":
            paths.append(os.path.join(folder, "duplication-badge-clones.svg"))
            with open(paths[-1], "w") as f:
                f.write(badges(stats)["clones"])
    return paths


def exceeds(stats: DataFrame, threshold: float) -> bool:
    """Whether the total percentage is strictly above the threshold."""
    return bool(stats.where((F.col("pool") == "*") & (F.col("percentage") > threshold)).count())
