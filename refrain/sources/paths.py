"""Globs and ignore files as regular expressions, so that paths are filtered by the engine."""

from __future__ import annotations

import re


def glob_regex(glob: str, anywhere: bool = True) -> str:
    """A pattern that matches whole paths; ``anywhere`` also tries it under every folder."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(x, False)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return ("^(?:.*/)?" if anywhere and not glob.startswith("/") else "^") + out.removeprefix("/") + "$"


def gitignore_rules(text: str, folder: str = "") -> list[tuple[str, bool, bool]]:
    """(pattern, whether it ignores, whether only folders) of an ignore file's lines, in order; patterns match whole paths of files or folders."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        ignores = not line.startswith("!")
        line = line.removeprefix("!").removeprefix("\\")
        only_folder, anchored = line.endswith("/"), "/" in line.rstrip("/")
        body = glob_regex(line.strip("/"), not anchored)[1:-1]
        prefix = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
        rules.append((f"^{prefix}{body}$", ignores, only_folder))
    return rules


def ignored(path, rules: list[tuple[str, bool, bool]]):
    """A condition on a path column: of the rules that match the path, or a folder above it, the last one ignores it. What lies in an ignored folder can't be told apart again."""
    from pyspark.sql import functions as F

    parts = F.split(path, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), (n < F.size(parts)).alias("folder")))

    def judged(step):
        out = F.lit(False)
        for pattern, ignores, only_folder in rules:
            out = F.when(step["path"].rlike(pattern) & (step["folder"] | F.lit(not only_folder)), F.lit(ignores)).otherwise(out)
        return out

    return F.exists(steps, judged) if rules else F.lit(False)
