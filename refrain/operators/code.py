"""Tokens of source code: comments, strings and embedded sections, which need state that built-in functions can't hold.

Texts are tokenised where they lie, in Arrow batches. A section of a page, component,
Markdown or Razor file is a stream of its own format, with places in its file. A JavaScript
lexer knows strings, templates, regular expressions and comments; types of TypeScript can
be erased by a documented subset of rules: interfaces, type aliases, ``declare`` and
``import type`` statements, ``as``/``satisfies`` casts, non-null marks, access modifiers
and annotations of names and parameters.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Formats by how they mark comments; all others are C's.
HASH = {"python", "ruby", "perl", "bash", "sh", "zsh", "fish", "r", "julia", "yaml", "toml", "dockerfile", "makefile", "cmake", "coffeescript", "crystal", "nim", "gdscript", "elixir", "awk", "tcl", "powershell", "puppet", "ignore"}
DASHES = {"sql", "haskell", "elm", "ada", "plsql"}
SEMICOLON = {"ini", "properties", "asm6502", "nasm", "lisp", "clojure", "scheme", "racket"}
QUOTE = {"vb", "vbs", "basic", "vbnet", "visual-basic"}
C_LINE, C_BLOCK = "//", ("/*", "*/")
SCRIPT = {"javascript", "typescript", "jsx", "tsx"}
#: Marks of regions that are left out, whatever tool they name.
START, END = re.compile(r"\w:ignore-start"), re.compile(r"\w:ignore-end")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)[^\n]*$", re.M)
FRONT = re.compile(r"\A---[ \t]*\n(.*?)^---[ \t]*$", re.M | re.S)
NO_BREAK = re.compile(r"[^\n]")
BLOCK = re.compile(r"<(template|script|style)\b([^>]*)>(.*?)</\1>", re.S | re.I)
LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""")
DEFAULTS = {"script": "javascript", "style": "css", "template": "markup"}
NAMES = {"ts": "typescript", "js": "javascript", "md": "markdown", "py": "python", "sh": "bash", "yml": "yaml", "html": "markup"}


def comment_style(fmt: str) -> tuple[str, tuple[str, str] | None]:
    """(line comment, block comment) of a format; unknown ones are C's."""
    if fmt in HASH:
        return "#", None
    if fmt in DASHES or fmt == "lua":
        return "--", None
    if fmt in SEMICOLON:
        return ";", None
    if fmt in QUOTE:
        return "'", None
    return C_LINE, C_BLOCK


OPERATORS = [">>>=", "...", "===", "!==", "**=", "<<=", ">>=", ">>>", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "**"]


def _lexer(fmt: str) -> re.Pattern:
    line, block = comment_style(fmt)
    script, parts = fmt in SCRIPT, []
    if block:
        parts.append(f"(?P<block>{re.escape(block[0])}.*?(?:{re.escape(block[1])}|\\Z))")
    parts.append(f"(?P<comment>{re.escape(line)}[^\\n]*)")
    if script:
        parts.append(r"(?P<string>`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')")
        parts.append(f"(?P<operator>{'|'.join(map(re.escape, OPERATORS))})")
    else:  # a string that isn't closed goes to the end of its line
        parts.append(r"(?P<string>\"(?:\\[^\n]|[^\"\n])*\"?|'(?:\\[^\n]|[^'\n])*'?)")
    parts += [r"(?P<whitespace>[^\S\n]+|\n)", r"(?P<literal>[0-9][0-9.]*)", r"(?P<identifier>[\w$]+)" if script else r"(?P<identifier>(?!\d)\w+)", r"(?P<punctuation>.)"]
    return re.compile("|".join(parts), re.S)


LEXERS: dict[str, re.Pattern] = {}
#: Own tokenizers by format: functions of a text that yield (kind, value, offset) of every character.
TOKENIZERS: dict = {}
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}


#: Kinds of tokens by the groups of a lexer that aren't named like them.
KIND_OF = {"block": "comment", "string": "literal", "operator": "punctuation"}


def lex(text: str, fmt: str):
    """(kind, value, offset) of every character; in scripts a slash where no value ends begins a regular expression."""
    if fmt in TOKENIZERS:
        yield from TOKENIZERS[fmt](text)
        return
    rx = LEXERS.get(fmt) or LEXERS.setdefault(fmt, _lexer(fmt))
    if fmt not in SCRIPT:
        yield from _plain(text, rx)
        return
    at, last = 0, ""
    while at < len(text):
        if text[at] == "/" and (not last or last in BEFORE_REGEX or not (last[-1].isalnum() or last[-1] in "_$)]}\"'`")) and (m := REGEX.match(text, at)):
            kind = "literal"
        else:
            m = rx.match(text, at)
            kind = KIND_OF.get(m.lastgroup, m.lastgroup)
        yield kind, m.group(), at
        at = m.end()
        if kind not in ("whitespace", "comment"):
            last = m.group()


def _plain(text: str, rx: re.Pattern):
    """lex() of what isn't a script, where no token depends on another."""
    for m in rx.finditer(text):
        kind = m.lastgroup
        if kind == "block":  # its marks and each character within are tokens
            at, end = m.span()
            inner = end - 2 * (end - at > 3 and m.group().endswith("*/"))
            for x, y in ((at, at + 2), *((i, i + 1) for i in range(at + 2, inner)), *(((inner, end),) if inner < end else ())):
                yield "whitespace" if text[x:y] == "\n" else "comment", text[x:y], x
        else:
            yield KIND_OF.get(kind, kind), m.group(), m.start()


FALLBACK = re.compile(r"[\w$]+|[^\S\n]+|\n|.", re.S)


def fallback(text: str):
    """(kind, value, offset) of a script that can't be lexed: words and single signs, without strings or comments."""
    for m in FALLBACK.finditer(text):
        yield "whitespace" if m.group().isspace() else "other", m.group(), m.start()


def lexed(text: str, fmt: str) -> list[tuple[str, str, int]]:
    """lex(), or for a script with a string or comment that isn't closed, its fallback."""
    found = list(lex(text, fmt))
    if fmt in SCRIPT and fmt not in TOKENIZERS and any(value in "\"'`" if kind == "punctuation" else kind == "comment" and value.startswith("/*") and (len(value) < 4 or not value.endswith("*/")) for kind, value, _ in found):
        return list(fallback(text))
    return found


def sections(text: str, fmt: str) -> list[tuple[str, str, int]]:
    """(format, text, offset) of a file's sections; what lies outside them is blanked to keep places."""
    found: list[tuple[str, int, int, int, int]] = []  # format, inner start, inner end, outer start, outer end
    if fmt == "markdown":
        if m := FRONT.match(text):
            found.append(("yaml", m.start(1), m.end(1), m.start(), m.end()))
        at = found[0][4] if found else 0
        while m := FENCE.search(text, at):
            close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", re.M).search(text, m.end())
            inner, outer = (close.start(), close.end()) if close else (len(text), len(text))
            low = m[2].lower()
            found.append((NAMES.get(low, low) or "text", min(m.end() + 1, inner), inner, m.start(), outer))
            at = outer
        rest = "markdown"
    elif fmt in ("vue", "svelte", "astro", "markup", "html"):
        if fmt == "astro" and (m := FRONT.match(text)):
            found.append(("typescript", m.start(1), m.end(1), m.start(), m.end()))
        for m in BLOCK.finditer(text, found[0][4] if found else 0):
            lang = LANG.search(m[2])
            name = lang[1].lower() if lang else DEFAULTS[m[1].lower()]
            found.append((NAMES.get(name, name), m.start(3), m.end(3), m.start(), m.end()))
        rest = "markup"
    elif fmt == "razor":
        for m in re.finditer(r"@(?:code|functions)?\s*\{", text):
            if found and m.start() < found[-1][4]:
                continue
            depth, end = 0, len(text)
            for p in re.finditer(r"[{}]", text[m.end() - 1 :]):
                depth += 1 if p[0] == "{" else -1
                if not depth:
                    end = m.end() + p.start()
                    break
            found.append(("csharp", m.end(), end - 1, m.start(), end))
        rest = "markup"
    else:
        return [(fmt, text, 0)]
    left, at = [], 0
    for _, _, _, start, end in found:
        left += [text[at:start], NO_BREAK.sub(" ", text[start:end])]
        at = end
    return [(f, text[s:e], s) for f, s, e, _, _ in found] + [(rest, "".join([*left, text[at:]]), 0)]


ERASE = re.compile(
    r"""\bimport\s+type\b[^;\n]*;?|\bexport\s+type\s*\{[^}]*\}[^;\n]*;?|\b(?:export\s+)?(?:declare\s+[^\n{;]*(?:\{[^}]*\}|;|$))|\b(?:export\s+)?interface\s+\w+[^{]*\{(?:[^{}]|\{[^{}]*\})*\}|\b(?:export\s+)?type\s+\w+(?:<[^>]*>)?\s*=[^;]*;"""
    r"""|\s+(?:as|satisfies)\s+[\w.$]+(?:<[^>]*>)?(?:\[\])*|(?<=[\w)\]])!(?=[.;,)\]])|\b(?:public|private|protected|readonly|abstract|override)\s+(?=[\w#\[])|(?<=[\w)\]])\??\s*:\s*[\w.$]+(?:<[^<>]*>)?(?:\[\])*(?:\s*\|\s*[\w.$'"]+(?:\[\])*)*(?=\s*[,)=;{])""",
    re.M,
)


def erase_types(text: str) -> str:
    """TypeScript without its types, blanked so that places stay."""
    return ERASE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def byte_places(text: str) -> np.ndarray | range:
    """UTF-8 bytes before each character, and before the end."""
    if text.isascii():
        return range(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])


def left_out(text: str, starts: list[int], patterns: list[re.Pattern]) -> tuple[list[int], list[int]]:
    """Starts and ends of the ranges that are left out, merged and in order: matches of ``patterns``, and whole lines between ignore marks."""
    ranges, opened = [m.span() for p in patterns for m in p.finditer(text) if m.end() > m.start()], None
    for at, line in zip(starts, text.split("\n"), strict=True):
        if opened is None and START.search(line):
            opened = at
        if opened is not None and END.search(line):
            ranges.append((opened, at + len(line)))
            opened = None
    if opened is not None:
        ranges.append((opened, len(text)))
    merged: list[list[int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [x for x, _ in merged], [x for _, x in merged]


COMPONENTS = {"vue", "svelte", "astro"}


def kept(text: str, fmt: str, dropped: set[str], patterns: list[re.Pattern], erase: bool, blocks_only: bool = False, starts: list[int] | None = None):
    """(format, [(kind, value, place)]) of each section of a text; ``blocks_only`` leaves out what lies between the blocks of a component."""
    if starts is None:
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
    begins, ends = left_out(text, starts, patterns)
    found = sections(text, fmt)
    for name, part, base in found[:-1] if blocks_only and fmt in COMPONENTS else found:
        if erase and name in ("typescript", "tsx"):
            part = erase_types(part)
        out = [(kind, value, at + base) for kind, value, at in lexed(part, name) if kind not in dropped]
        if begins:
            out = [x for x in out if not ((i := bisect.bisect_right(ends, x[2])) < len(ends) and begins[i] < x[2] + len(x[1]))]
        yield name, out


def read(text: str, fmt: str, dropped: set[str], patterns: list[re.Pattern], ignore_case: bool, erase: bool, blocks_only: bool = False):
    """kept() with (kind, value, line, place, line's place) of each token."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    for name, found in kept(text, fmt, dropped, patterns, erase, blocks_only, starts):
        out = []
        for kind, value, at in found:
            line = bisect.bisect_right(starts, at)
            out.append((kind, value.lower() if ignore_case else value, line, at, starts[line - 1]))
        yield name, out


DROPPED = {"strict": frozenset(), "mild": frozenset({"whitespace"}), "weak": frozenset({"whitespace", "comment"})}


def _compiled(ignore_pattern: list[str] | None) -> list[re.Pattern]:
    """Patterns that don't compile are skipped."""
    out = []
    for p in ignore_pattern or []:
        try:
            out.append(re.compile(p, re.M))
        except re.error:
            continue
    return out


def tokens(sources: DataFrame, mode: str = "mild", ignore_case: bool = False, ignore_pattern: list[str] | None = None, erase: bool = False, blocks_only: bool = False) -> DataFrame:
    """(source_id, format, pos, kind, value, line, col, offset) of ``sources`` (source_id, format, content).

    Lines and columns count from 1 and 0, columns and offsets in UTF-8 bytes of the whole
    file. Regions between ignore marks are dropped by whole lines, as is what overlaps a
    match of ``ignore_pattern`` (patterns that don't compile are skipped).
    """
    patterns, dropped = _compiled(ignore_pattern), DROPPED[mode]
    kind_of = sources.schema["source_id"].dataType.simpleString()
    names = ["source_id", "format", "pos", "kind", "value", "line", "col", "offset"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            for source_id, fmt, content in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                places = byte_places(content or "")
                for name, found in read(content or "", fmt or "txt", dropped, patterns, ignore_case, erase, blocks_only):
                    out = [[name] * len(found), range(len(found)), [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], [places[x[3]] - places[x[4]] for x in found], [places[x[3]] for x in found]]
                    yield pa.RecordBatch.from_arrays([pa.array([source_id.as_py()] * len(found), batch.schema.field(0).type), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=names)

    return sources.select("source_id", "format", "content").mapInArrow(run, f"source_id {kind_of}, format string, pos int, kind string, value string, line int, col int, offset int")


def kinds(text: str, fmt: str, dropped: set[str]):
    """(format, Counter of kinds) of each section as kept() has them, without making tokens where none depends on another."""
    if "ignore-start" in text:
        yield from ((name, Counter(x[0] for x in found)) for name, found in kept(text, fmt, dropped, [], False))
        return
    for name, part, _ in sections(text, fmt):
        groups = None
        if name not in SCRIPT and name not in TOKENIZERS:
            groups = Counter(map(attrgetter("lastgroup"), (LEXERS.get(name) or LEXERS.setdefault(name, _lexer(name))).finditer(part)))
        if groups is None or "block" in groups:
            groups = Counter(kind for kind, _, _ in lexed(part, name))
        found: Counter = Counter()
        for group, n in groups.items():
            if (kind := KIND_OF.get(group, group)) not in dropped:
                found[kind] += n
        yield name, found


def kind_counts(sources: DataFrame, mode: str = "mild") -> DataFrame:
    """(format, kind, n) of tokens(), counted where the sources lie: no token leaves its task."""
    dropped = DROPPED[mode]

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for fmt, content in zip(batch.column(0), batch.column(1), strict=True):
                for name, found in kinds(content.as_py() or "", fmt.as_py() or "txt", dropped):
                    for kind, n in found.items():
                        counts[name, kind] += n
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in counts], pa.string()), pa.array([x[1] for x in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["format", "kind", "n"])

    return sources.select("format", "content").mapInArrow(run, "format string, kind string, n long").groupBy("format", "kind").agg(F.sum("n").alias("n"))


def display_tokens(sources: DataFrame, mode: str = "mild") -> DataFrame:
    """(source_id, pos, format, kind, value, line, col): all tokens of a file in the order of their places, whatever section they are of; of components only those of their blocks."""
    each = tokens(sources, mode, blocks_only=True).withColumnRenamed("format", "section")
    ordered = each.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("offset", "section", "kind", "value", "line", "col"))).alias("t"))
    return ordered.select("source_id", F.posexplode("t").alias("pos", "t")).select("source_id", "pos", F.col("t.section").alias("format"), "t.kind", "t.value", "t.line", "t.col")


def arrays(sources: DataFrame, mode: str = "mild", ignore_case: bool = False, ignore_pattern: list[str] | None = None, erase: bool = False) -> DataFrame:
    """(source_id, format, values, lines): tokens() of each source's formats as arrays in the order of their places, made where the source lies."""
    patterns, dropped = _compiled(ignore_pattern), DROPPED[mode]
    kind_of = sources.schema["source_id"].dataType.simpleString()
    names, kinds = ["format", "values", "lines"], [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            ids, out = [], [[], [], []]
            for source_id, fmt, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by_format: dict[str, list] = {}
                for name, found in read(content or "", fmt or "txt", dropped, patterns, ignore_case, erase):
                    by_format.setdefault(name, []).extend(found)
                for name, found in by_format.items():
                    if found:
                        found.sort(key=lambda x: x[3])
                        ids.append(source_id)
                        for column, x in zip(out, (name, [x[1] for x in found], [x[2] for x in found]), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=["source_id", *names])

    return sources.select("source_id", "format", "content").mapInArrow(run, f"source_id {kind_of}, format string, values array<string>, lines array<int>")


def section_arrays(sources: DataFrame, **options) -> DataFrame:
    """(source_id, pool, values, lines) of every section, as clone detection reads them: source_id is ``id:format``."""
    return arrays(sources, **options).select(F.concat_ws(":", "source_id", "format").alias("source_id"), F.col("format").alias("pool"), "values", "lines")
