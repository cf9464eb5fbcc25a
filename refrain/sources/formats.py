"""Formats of sources: by extension, by file name, by first line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The known formats in the order of their registration, each with its extensions; the last registration of an extension counts.
WITH_EXTENSIONS = """
actionscript: as
ada: ada
apl: apl
aspnet: asp aspx
bash: sh ksh bash
basic: bas
brainfuck: b bf
c: c z80
c-header: h
clojure: cljs clj cljc cljx edn
coffeescript: coffee
cpp: cpp c++ cc cxx
cpp-header: hpp h++ hh hxx
crystal: cr
csharp: cs
css: css gss
d: d
dart: dart
diff: diff patch
eiffel: e
elm: elm
erlang: erl erlang
fortran: f for f77 f90
fsharp: fs
gdscript: gd
gherkin: feature
go: go
graphql: graphql
groovy: groovy gradle
haml: haml
handlebars: hb hbs handlebars
haskell: hs lhs
haxe: hx hxml
ini: ini
java: java
javascript: js es es6 mjs cjs
json: json map jsonld
jsx: jsx
julia: jl
kotlin: kt kts
latex: tex
less: less
lisp: cl lisp el
livescript: ls
lua: lua
markdown: md markdown mkd
markup: html htm xml xsl xslt svg ejs jsp
nsis: nsh nsi
objectivec: m mm
ocaml: ocaml ml mli mll mly
oz: oz
pascal: pas p
perl: pl pm
php: php phtml
plsql: plsql
powershell: ps1 psd1 psm1
prolog: pro
properties: properties
protobuf: proto
pug: pug jade
puppet: pp puppet
python: py pyx pxd pxi
q: q
r: r R
razor: cshtml razor
ruby: rb
rust: rs
sas: sas
sass: sass
scala: scala
scheme: scm ss
scss: scss
svelte: svelte
smalltalk: st
smarty: smarty tpl
soy: soy
sql: sql cql
stylus: styl stylus
swift: swift
tap: tap
tcl: tcl
textile: textile
tsx: tsx
tt2: tt2
twig: twig
typescript: ts mts cts
txt: txt
vbnet: vb
velocity: vtl
verilog: v
vhdl: vhd vhdl
astro: astro
vue: vue
xquery: xy xquery
yaml: yaml yml
antlr4: g4
apex: cls trigger apex
awk: awk
bicep: bicep
cfscript: cfc
cfml: cfm
cmake: cmake
csv: csv
dot: dot gv
excel-formula: xlsx xls
gettext: po
hcl: tf hcl
idris: idr
ignore: gitignore
json5: json5
lilypond: ly
linker-script: ld
llvm: ll
log: log
openqasm: qasm
plant-uml: puml plantuml
powerquery: pq
purescript: purs
qsharp: qs
racket: rkt
rescript: res
robotframework: robot
solidity: sol
sparql: rq
toml: toml
turtle: ttl
unrealscript: uc
wgsl: wgsl
wolfram: wl nb
zig: zig
"""
# The formats that have no extension of their own.
WITHOUT_EXTENSION = """
abap apacheconf applescript arduino arff asciidoc asm6502 autohotkey autoit batch bison bro clike comments csp css-extras django docker elixir erb
flow gedcom git glsl hpkp hsts http ichigojam icon inform7 io j jolie keymap liquid lolcode makefile matlab mel mizar monkey n4js nasm nginx nim nix
opencl parigp processing pure qore reason renpy rest rip roboconf vim visual-basic wasm wiki xeora xojo abnf agda aql armasm bnf cobol cypher dhall
dns-zone-file ebnf editorconfig factor ftl gcode gml go-module hlsl jq kusto mermaid mongodb n1ql odin promql regex rego shell-session smali stata
typoscript uri vala
"""
EXTENSIONS: dict[str, str] = {ext: name for name, _, exts in (line.partition(":") for line in WITH_EXTENSIONS.strip().splitlines()) for ext in exts.split()}
FORMATS: list[str] = [line.partition(":")[0] for line in WITH_EXTENSIONS.strip().splitlines()] + WITHOUT_EXTENSION.split()
# What a first line names, in the order that is tried.
SHEBANGS = [("python", "python"), ("node", "javascript"), ("ruby", "ruby"), ("bash", "bash"), ("/sh", "bash"), ("perl", "perl"), ("php", "php")]
# Interpreters by base name.
INTERPRETERS = {"bash": "bash", "sh": "bash", "zsh": "bash", "dash": "bash", "ksh": "bash", "python": "python", "ruby": "ruby", "perl": "perl", "php": "php", "node": "javascript", "nodejs": "javascript", "lua": "lua", "tclsh": "tcl", "wish": "tcl", "groovy": "groovy", "awk": "awk", "gawk": "awk", "nawk": "awk", "rscript": "r"}
# Names that stand for a format besides its extensions.
SYNONYMS = {"node": "javascript", "shell": "bash", "zsh": "bash", "golang": "go"}


def list_formats() -> list[str]:
    return list(FORMATS)


def dimension(spark: SparkSession) -> DataFrame:
    """(ext, format): a fixed table of a few hundred rows."""
    return spark.createDataFrame(sorted(EXTENSIONS.items()), "ext string, format string")


def resolve_format(hint: str) -> str | None:
    """A format by synonym, extension or name, whatever its case."""
    low = hint.lower()
    return SYNONYMS.get(low) or EXTENSIONS.get(low) or (low if low in FORMATS else None)


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table.items()]), lambda x: x["k"] == key), 0)["v"] if table else F.lit(None).cast("string")


def by_shebang(line: Column) -> Column:
    out = None
    for sign, name in SHEBANGS:
        test = line.startswith("#!") & line.contains(sign)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def by_interpreter(line: Column) -> Column:
    """The stricter reading of a first line: the interpreter's base name in lower case, past env without options, without its version."""
    name = F.regexp_extract(line, r"^#!\s*(?:(?:\S*/)?env\s+(?!-))?(?:\S*/)?([^\s/0-9][^\s/]*?)(?:[0-9]+(?:\.[0-9]+)*)?(?:\s|$)", 1)
    return _looked_up(INTERPRETERS, F.lower(name))


def detect(path: Column, content: Column, extensions: dict[str, str] | None = None, names: dict[str, str] | None = None) -> Column:
    """Own file names, then own extensions, then built-in extensions, then the first line."""
    name, ext = F.regexp_extract(path, r"([^/]*)$", 1), F.regexp_extract(path, r"\.([^./]+)$", 1)
    built = F.coalesce(_looked_up(EXTENSIONS, ext), _looked_up(EXTENSIONS, F.lower(ext)))
    return F.coalesce(_looked_up(names or {}, name), _looked_up(extensions or {}, ext), built, by_shebang(F.substring_index(content, "\n", 1)))
