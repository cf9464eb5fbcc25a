"""Scalar expressions of reports and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def badge_color(percentage: Column) -> Column:
    """Above 20 red, above 10 amber, else green."""
    return F.when(percentage > 20, "red").when(percentage > 10, "amber").otherwise("green")


def severity(tokens: Column, cutoff: int, over: Column | None = None, new: Column | None = None) -> Column:
    """error for long or new clones, or where the gate fails; else warning."""
    bad = tokens >= cutoff
    for more in (over, new):
        if more is not None:
            bad = bad | more
    return F.when(bad, "error").otherwise("warning")


def human_size(size: Column) -> Column:
    """B, KB, MB or GB of 1024, one decimal above B."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, of in (("KB", 1024), ("MB", 1024**2), ("GB", 1024**3)):
        out = F.when(size >= of, F.format_string(f"%.1f {unit}", size.cast("double") / of)).otherwise(out)
    return out


def clamped(percentage: Column) -> Column:
    return F.least(F.lit(100.0), percentage)


def location(line: Column, column: Column) -> Column:
    """line:column, the column counted from 1."""
    return F.concat_ws(":", line, column + 1)


def xml_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def cdata(text: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def label_escape(text: Column) -> Column:
    """Label values of metric lines."""
    for sign, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def parent_dir(path: Column) -> Column:
    """The folder of a path; ``.`` at the root."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", ".").otherwise(found)


def clean_id(source_id: Column) -> Column:
    """Without the ``:format`` of a section; drive letters stay."""
    return F.regexp_replace(source_id, r"(?<=..):[a-z0-9+-]+$", "")


def relative_to(path: Column, root: str) -> Column:
    """Below ``root``, or as it is."""
    root = root.rstrip("/") + "/"
    return F.regexp_replace(F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path), r"^\./", "")


def older_side(a: Column, b: Column) -> Column:
    """Which of two timestamps comes first: ``=>`` the first, ``<=`` the second, ``==`` neither."""
    return F.when(a < b, "=>").when(b < a, "<=").otherwise("==")


def fingerprint_text(value: Column) -> Column:
    """64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
