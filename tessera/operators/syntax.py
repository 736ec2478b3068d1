"""Symbols of SystemVerilog sources: a tokenizer that finds declarations and references, reachability, renaming.

No full parser: macros are not expanded. Conditional compilation is evaluated for the defines of a file's group, and for
those that the file makes itself. A file counts as parsed when its brackets and block keywords balance, and as encrypted
when it has a protected envelope.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from . import graph

TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[A-Za-z_]\w*|\\\S+|[$A-Za-z_][\w$]*|\d[\w\'.]*|::|[^\s]', re.S)
BLOCKS = {"module": "endmodule", "macromodule": "endmodule", "interface": "endinterface", "package": "endpackage", "program": "endprogram", "class": "endclass"}
PAIRS = {"function": "endfunction", "task": "endtask", "case": "endcase", "generate": "endgenerate", "begin": "end", **BLOCKS}
#: Scope names that are never renamed.
RESERVED = frozenset(["$unit", "local", "super", "this", "std"])
KEYWORDS = frozenset(
    "module macromodule interface package program class endmodule endinterface endpackage endprogram endclass function endfunction task endtask case casez casex endcase generate endgenerate begin end if else for foreach while "
    "do repeat forever assign always always_comb always_ff always_latch initial final input output inout ref parameter localparam logic wire reg bit byte int integer longint shortint real time string typedef enum struct union packed "
    "signed unsigned import export virtual extends implements return default static automatic const var void genvar posedge negedge or and not property sequence assert assume cover modport clocking unique priority inside with "
    "new null this super local extern pure constraint rand randc covergroup endgroup specify endspecify primitive endprimitive table endtable supply0 supply1 tri wand wor alias bind chandle event fork join join_any join_none disable wait".split()
)


DIRECTIVE = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`(ifdef|ifndef|elsif|else|endif|define|undef)\b[ \t]*([A-Za-z_]\w*)?', re.S)


def active(text: str, defines: frozenset[str] = frozenset()) -> tuple[str, bool]:
    """``text`` with what conditions leave out as blanks, so that places stay, and whether conditions balance. Names are
    defined by ``defines`` and by the text itself."""
    known, stack, out, at, sound = set(defines), [], [], 0, True

    def on() -> bool:
        return all(now for now, _ in stack)

    def blank(piece: str) -> str:
        return piece if on() else re.sub(r"[^\n]", " ", piece)

    for m in DIRECTIVE.finditer(text):
        word, name = m[1], m[2]
        if word is None:
            continue
        out.append(blank(text[at : m.start()]))
        at = m.end() if word in ("ifdef", "ifndef", "elsif") else m.start() + 1 + len(word)
        if word in ("define", "undef"):
            if on() and name:
                (known.add if word == "define" else known.discard)(name)
            out.append(blank(text[m.start() : at]))
            continue
        out.append(re.sub(r"[^\n]", " ", text[m.start() : at]))
        if word in ("ifdef", "ifndef"):
            now = (name in known) == (word == "ifdef")
            stack.append((now, now))
        elif not stack:
            sound = False
        elif word == "endif":
            stack.pop()
        else:
            _, taken = stack.pop()
            now = not taken and (word == "else" or name in known)
            stack.append((now, taken or now))
    out.append(blank(text[at:]))
    return "".join(out), sound and not stack


def scan(text: str, defines: frozenset[str] = frozenset()) -> dict:
    """declared, referenced and included names of a source, with the places of names for renaming."""
    text, sound = active(text, defines)
    tokens = [(m[0], m.start()) for m in TOKEN.finditer(text) if not m[0].startswith(("//", "/*"))]
    words = [t for t, _ in tokens]
    declared, referenced, included, places = [], [], [], []
    open_blocks: list[str] = []
    brackets: list[str] = []
    ok = True
    encrypted = bool(re.search(r"`pragma\s+protect\s+begin_protected|`protected\b", text))

    def name_at(i: int, kind: str) -> None:
        places.append((words[i], tokens[i][1], kind))
        (declared if kind == "decl" else referenced).append(words[i])

    is_name = lambda i: 0 <= i < len(words) and re.fullmatch(r"[A-Za-z_][\w$]*", words[i]) and words[i] not in KEYWORDS
    for i, w in enumerate(words):
        if w in "([{":
            brackets.append({"(": ")", "[": "]", "{": "}"}[w])
        elif w in (")", "]", "}"):
            ok = ok and bool(brackets) and brackets.pop() == w
        elif w == "`include" and i + 1 < len(words):
            included.append(words[i + 1].strip('"<>'))
        elif w in BLOCKS and not (w in ("interface", "class") and i and words[i - 1] in ("virtual", "typedef")) or w == "class" and i and words[i - 1] == "virtual":
            j = i + 1
            while j < len(words) and words[j] in ("automatic", "static"):
                j += 1
            if is_name(j):
                name_at(j, "decl")
                open_blocks.append(BLOCKS[w])
        elif w in BLOCKS.values():
            ok = ok and bool(open_blocks) and open_blocks.pop() == w
            if i + 2 < len(words) and words[i + 1] == ":" and is_name(i + 2):
                places.append((words[i + 2], tokens[i + 2][1], "label"))
        elif w == "::" and i and words[i - 1] not in RESERVED and is_name(i - 1):
            name_at(i - 1, "ref")
        elif w == "virtual" and i + 1 < len(words):
            j = i + 2 if words[i + 1] == "interface" else i + 1
            if is_name(j):
                name_at(j, "ref")
        elif w == "extends" and is_name(i + 1):
            name_at(i + 1, "ref")
        elif is_name(i) and open_blocks and (i == 0 or words[i - 1] in (";", "end", "begin", ")", "endgenerate", "generate", "else") or words[i - 1] in BLOCKS.values()):
            j = i + 1
            if j < len(words) and words[j] == "#":
                j = _closed(words, j + 1)
            if is_name(j) and j + 1 < len(words) and (words[j + 1] == "(" or words[j + 1] == "[" and "(" in words[j + 1 : j + 12]):
                name_at(i, "ref")
        elif is_name(i) and i and words[i - 1] in ("(", ",") and i + 2 < len(words) and words[i + 1] == "." and is_name(i + 2):
            name_at(i, "ref")
    ok = ok and sound and not brackets and not open_blocks
    return {"ok": ok and not encrypted, "encrypted": encrypted, "declared": declared, "referenced": sorted(set(referenced)), "included": included, "places": places}


def _closed(words: list[str], i: int) -> int:
    """The place after a parenthesis that opens at ``i``, or after one word."""
    if i >= len(words) or words[i] != "(":
        return i + 1
    depth = 0
    while i < len(words):
        depth += (words[i] == "(") - (words[i] == ")")
        i += 1
        if not depth:
            break
    return i


def renamed(text: str, names: dict[str, str], defines: frozenset[str] = frozenset()) -> str:
    """``text`` with declarations, end labels and references renamed; the rest, also what conditions leave out, stays."""
    if not names:
        return text
    out, at = [], 0
    for name, start, _ in sorted(scan(text, defines)["places"], key=lambda x: x[1]):
        if name in names and start >= at:
            out += [text[at:start], names[name]]
            at = start + len(name)
    return "".join(out) + text[at:]


def shown(text: str, *, squash: bool = False, comments: bool = True) -> str:
    """``text`` without comments unless ``comments``; with ``squash`` without empty lines."""
    out = text if comments else re.sub(r'("(?:\\.|[^"\\\n])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r"[ \t]*\n(?:[ \t]*\n)+", "\n", out) if squash else out


def without_comments(text: str, squash: bool = False) -> str:
    return shown(text, squash=squash, comments=False)


def parse(files: DataFrame) -> DataFrame:
    """(idx, path, parsed_ok, encrypted, declared, referenced, included) of files (idx, path, text), and where there is such
    a column, under the names of ``defines`` of each file's group. A file without a text cannot be read: an error."""
    ship_package(files.sparkSession)
    given = F.col("defines") if "defines" in files.columns else F.expr("cast(array() as array<string>)")
    there = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no text of "), "path")).cast("string")).otherwise(F.col("text"))

    def run(batches):
        for pdf in batches:
            found = [scan(t, frozenset(d)) for t, d in zip(pdf["text"], pdf["defines"], strict=True)]
            yield pdf[["idx", "path"]].assign(parsed_ok=[f["ok"] for f in found], encrypted=[f["encrypted"] for f in found], declared=[f["declared"] for f in found], referenced=[f["referenced"] for f in found], included=[f["included"] for f in found])

    return files.select("idx", "path", there.alias("text"), given.alias("defines")).mapInPandas(run, "idx long, path string, parsed_ok boolean, encrypted boolean, declared array<string>, referenced array<string>, included array<string>")


def parse_groups(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """The Verilog files of flattened groups (pkg, at, dirs, exported, defines, files), parsed under their group's defines: idx
    (their place in the whole list), path, and what ``parse`` finds; with the include directories of each group as
    ``dirs``. ``texts`` (path, text)."""
    from ..plans.resolve import interned

    files = groups.select("at", "dirs", "exported", F.transform("defines", lambda d: d["name"]).alias("defines"), F.posexplode("files").alias("pos", "f")).where("f.file_type = 'verilog'")
    files = files.select("at", "pos", F.col("f.path").alias("path"), "defines", F.array_distinct(F.concat("dirs", "exported")).alias("dirs"))
    numbers = interned(files, ["at", "pos"])
    named = files.join(numbers, ["at", "pos"]).select(F.col("ref").cast("long").alias("idx"), "path", "defines", "dirs")
    return parse(named.join(texts, "path", "left")).join(named.select("idx", "dirs"), "idx")


def headers_of(trees: DataFrame, listing: DataFrame) -> DataFrame:
    """(idx, path): header files that parsed files include (idx, included, dirs), by the first of their own group's directories
    that has one. ``listing`` (path)."""
    wanted = trees.select("idx", F.explode("included").alias("name"), "dirs").select("idx", "name", F.posexplode("dirs").alias("order", "dir"))
    found = wanted.select("idx", "name", "order", F.concat_ws("/", "dir", "name").alias("path")).join(listing.select("path").distinct(), "path")
    return found.groupBy("idx", "name").agg(F.min_by("path", "order").alias("path")).select("idx", "path").distinct()


def rename_files(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files (idx, text) with names replaced; ``names`` (name, new_name) reach a file only where it uses them."""
    ship_package(files.sparkSession)
    used = parse(files.withColumn("path", F.lit(""))).select("idx", F.explode(F.array_distinct(F.concat("declared", "referenced"))).alias("name"))
    own = used.join(names, "name").groupBy("idx").agg(F.map_from_entries(F.collect_set(F.struct("name", "new_name"))).alias("names"))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[renamed(t or "", dict(n) if n is not None else {}) for t, n in zip(pdf["text"], pdf["names"], strict=True)])[["idx", "text"]]

    return files.join(own, "idx", "left").select("idx", "text", "names").mapInPandas(run, "idx long, text string")


def last_declarations(declared: DataFrame) -> DataFrame:
    """(name, idx): the last tree that declares each name."""
    return declared.groupBy("name").agg(F.max("idx").alias("idx"))


def redeclared(declared: DataFrame) -> DataFrame:
    """(name, n) of names that several trees declare: the last one counts, and each of these deserves a warning."""
    return declared.groupBy("name").agg(F.count_distinct("idx").alias("n")).where("n > 1")


def symbol_edges(declared: DataFrame, referenced: DataFrame) -> DataFrame:
    """(src, dst): trees and the trees whose names they use; unknown names lead nowhere."""
    last = last_declarations(declared).withColumnRenamed("idx", "dst")
    return referenced.select(F.col("idx").alias("src"), "name").join(last, "name").select("src", "dst").distinct()


def reachable(declared: DataFrame, referenced: DataFrame, tops: list[str]) -> DataFrame:
    """(node): trees that the tops need; an unknown top is an error."""
    last = last_declarations(declared)
    start = last.where(F.col("name").isin(tops))
    missing = set(tops) - {r.name for r in start.select("name").collect()}
    if missing:
        raise ValueError(f"no such top: {', '.join(sorted(missing))}")
    return graph.closure(symbol_edges(declared, referenced), start.select(F.col("idx").alias("node")))


def parse_class(file_type: Column, parsed_ok: Column, protected: Column) -> Column:
    """other, ok, encrypted or broken."""
    return F.when(file_type.isNull() | (file_type != "verilog"), "other").when(parsed_ok, "ok").when(protected, "encrypted").otherwise("broken")


def retained(kind: Column, reached: Column | None, *, broken: str = "error", encrypted: str = "keep") -> Column:
    """Whether a file stays: broken and encrypted ones by policy (keep, drop, error), whatever the tops reach; the rest
    if no top is given or one reaches it."""
    by = lambda policy, what: F.raise_error(F.lit(f"a file is {what}")).cast("boolean") if policy == "error" else F.lit(policy == "keep")
    return F.when(kind == "other", F.lit(True)).when(kind == "broken", by(broken, "broken")).when(kind == "encrypted", by(encrypted, "encrypted")).otherwise(F.lit(True) if reached is None else reached)


def rename_map(declared: DataFrame, prefix: str, suffix: str, exclude: list[str]) -> DataFrame:
    """(name, new_name) for declared names."""
    kept = F.col("name").isin(exclude) if exclude else F.lit(False)
    return declared.select("name").distinct().select("name", F.when(kept, F.col("name")).otherwise(F.concat(F.lit(prefix), "name", F.lit(suffix))).alias("new_name"))


def renamed_counts(declared: DataFrame, referenced: DataFrame, names: DataFrame) -> DataFrame:
    """(declarations, uses): how many declared and referenced names (name) a map (name, new_name) changes."""
    changed = names.where("name <> new_name").select("name")
    own = declared.join(changed, "name", "left_semi").agg(F.count("*").alias("declarations"))
    return own.crossJoin(referenced.join(changed, "name", "left_semi").agg(F.count("*").alias("uses")))  # one row each


def resolved_headers(included: DataFrame, listing: DataFrame, dirs: DataFrame) -> DataFrame:
    """Distinct header paths: names (idx, name) found under an include directory (dir) in the listing (path)."""
    joined = included.crossJoin(F.broadcast(dirs)).select(F.concat_ws("/", "dir", "name").alias("path"))  # a few dozen directories
    return joined.distinct().join(listing, "path", "left_semi")
