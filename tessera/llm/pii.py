"""Operator 5: personal data, with offset-preserving deobfuscation.

The base detectors run on the text as it is. Transducers then rewrite it, each output character keeping the span
of source characters it came from: homoglyphs and foreign digits to ASCII, zero-width characters away, spelled
digits to digits (also where they alternate with figures), "(at)" and "dot" disguises to @ and full stop. The same detectors run on the rewritten text, and
their spans are mapped back. Base spans always stay; a rewritten span is added where no base span of its kind
already covers it.

Defined results: null text is empty and has no spans; offsets are code points, ends exclusive; repeated rows each
get their own output row; spans of different kinds may overlap and are all told, in order of start and kind (masking
takes the one that starts first, then the longest); texts of any length take time in proportion to their length; an
empty table gives an empty table; other columns are not read (``redact`` keeps them).

What is not found: an address with " at " and a host in plain writing after a word that prose has there ("find us at
example.org"), a host whose ending is neither of two letters nor in ENDINGS unless its full stop is disguised, and
identifiers split over lines by words.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty

KINDS = ("email", "ip", "card", "phone")
FOUND = "array<struct<kind:string,start:int,end:int,base:boolean>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits matches from its first digit or not at all, hence the lookbehind and the possessive runs.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіѕјһԁԛԝАВЕКМНОРСТУХІЅЈαονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjhdqwABEKMHOPCTYXISJaovptuikABEZHIKMNOPTYX", strict=True))
ZERO_WIDTH = "​‌‍⁠﻿­"
DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_WORD = "zero|one|two|three|four|five|six|seven|eight|nine|oh"
_SEP = r"[ \t]*[-.,/]?[ \t]*"
#: Three digits in words at least: fewer are prose.
SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{_WORD})(?![^\W_])(?:{_SEP})){{2,}}(?:{_WORD})(?![^\W_])")
ONE_WORD = re.compile(_WORD)
#: Words and figures in any order. Such a run is rewritten if it has as many digits as the shortest phone number, or
#: the three full stops of an address.
_PART = rf"(?:(?:{_WORD})|[0-9]++)(?![^\W_])"
MIXED = re.compile(rf"(?<![^\W_]){_PART}(?:[ \t().,/-]{{1,3}}{_PART})+")
PART = re.compile(rf"{_WORD}|[0-9]+")
LEAST_DIGITS = 10
BRACKET_AT = re.compile(r"[ \t]*[\[({<][ \t]*(?:at|@)[ \t]*[\])}>][ \t]*")
BRACKET_DOT = re.compile(r"[ \t]*[\[({<][ \t]*(?:dot|punkt|punto|point|\.)[ \t]*[\])}>][ \t]*")
#: Walks outwards from an " at " or a spaced mark: the local part before it, the labels after it.
AT = re.compile(r" at | ?@ ?")
LOCAL_WORD = re.compile(r"[a-z0-9_%+-][a-z0-9._%+-]*")
LABEL = re.compile(r"[a-z0-9-]+")
LABEL_DOT = re.compile(r" dot | ?\. ?")
LOCAL_DOT = " dot "
#: Endings of host names beside those of two letters.
ENDINGS = frozenset("com org net edu gov mil int info biz name dev app xyz online site shop tech cloud email".split())
#: Words before " at " that go on in prose ("find us at example.org"): with a host in plain writing they are no address.
PROSE = frozenset("us me it them him her you here there online available found find look looking visit more page pages site website and is are was were be shop download read see live located hosted posted published".split())
#: Full stops of an address in words or brackets are found between its figures.
IP_DOTS = re.compile(r"(?<![\w.])[0-9]{1,3}(?: dot [0-9]{1,3}| ?\. ?[0-9]{1,3}){3}(?![\w]|\.[0-9])")
SPACED_DOT = re.compile(r" dot | ?\. ?")
#: Cheap signs that a transducer may apply; they only save the slower patterns above.
TWO_WORDS = re.compile(rf"(?:{_WORD}){_SEP}(?:{_WORD})(?![^\W_])")
BESIDE_FIGURES = re.compile(rf"(?:{_WORD})[ \t().,/-]{{1,3}}[0-9]|[0-9][ \t().,/-]{{1,3}}(?:{_WORD})(?![^\W_])")
BRACKETED = re.compile(r"[\[({<][ \t]*(?:at|@|dot|punkt|punto|point|\.)[ \t]*[\])}>]")
FIGURE_DOT = re.compile(r"[0-9] (?:dot|\.)|[0-9]\. [0-9]")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ in turn: linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, done := m.end()))
        at = text.find("@", max(at + 1, done))
    return out


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := DIGITS_ONLY.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


DIGITS_ONLY = re.compile(r"[^0-9]")


@functools.cache
def letters() -> tuple[dict[int, str], frozenset[str]]:
    """One-to-one rewriting of characters: lookalikes, compatibility forms and digits of any script."""
    table = dict(LOOKALIKES)
    for point in (*range(0x0660, 0x2000), *range(0x2000, 0x20000)):
        c = chr(point)
        digit = unicodedata.decimal(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c) if point >= 0x2070 else ""
        if len(plain) == 1 and plain != c and (plain in LOCAL or plain == "@"):
            table.setdefault(c, plain)
    return str.maketrans(table), frozenset(table) | frozenset(ZERO_WIDTH)


class Rewritten:
    """A text with, for every character, the source span [first, end) that it stands for."""

    def __init__(self, text: str):
        self.text, self.first, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Puts ``new`` for [start, end), each of its characters standing for that whole span."""
        text, first, end, at = [], [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            first += self.first[at:a] + [self.first[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.first, self.end = first + self.first[at:], end + self.end[at:]


def _lower(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _mixed(text: str, low: str) -> list[tuple[int, int, str]]:
    """Changes that make figures of the words in mixed runs. What stands between a word and its neighbour goes, but for
    the full stops of an address. A word or two after an identifier in plain figures are prose."""
    changes, base = [], None
    for run in MIXED.finditer(low):
        parts = list(PART.finditer(low, run.start(), run.end()))
        words = [p[0] in DIGIT_WORDS for p in parts]
        gaps = [low[p.end() : q.start()] for p, q in zip(parts, parts[1:], strict=False)]
        address = gaps.count(".") == 3
        if not any(words) or all(words) or not address and sum(1 if w else len(p[0]) for p, w in zip(parts, words, strict=True)) < LEAST_DIGITS:
            continue
        base = detect(text) if base is None else base
        plain = [(s, e) for s, kind, e in base if kind and s < run.end() and run.start() < e]
        if plain and all(w or any(s <= p.start() and p.end() <= e for s, e in plain) for p, w in zip(parts, words, strict=True)):
            continue
        for i, p in enumerate(parts):
            beside = i < len(gaps) and (words[i] or words[i + 1]) and not (address and gaps[i] == ".")
            if words[i] or beside:
                new = DIGIT_WORDS[p[0]] if words[i] else p[0][-1]
                changes.append((p.start() if words[i] else p.end() - 1, parts[i + 1].start() if beside else p.end(), new))
    return changes


def _local_start(low: str, done: int, end: int) -> int:
    """Where the local part that ends at ``end`` begins, not before ``done``; words may be joined by " dot "."""
    start = end
    while True:
        at = start
        while at > done and low[at - 1] in LOCAL:
            at -= 1
        if at == start:
            return start + len(LOCAL_DOT) if start < end else end
        start = at
        if start - len(LOCAL_DOT) < done or not low.startswith(LOCAL_DOT, start - len(LOCAL_DOT)):
            return start
        start -= len(LOCAL_DOT)


def _disguised(text: str, low: str) -> list[tuple[int, int, str]]:
    """Changes that make an address of words around an " at " or a mark with spaces. Each is walked from once, left to
    the one before and right to the first word that no full stop joins, so the work follows the text's length."""
    changes, done = [], 0
    for m in AT.finditer(low):
        if m.start() < done or m.end() < len(low) and not LABEL.match(low, m.end()):
            continue
        start = _local_start(low, done, m.start())
        if start >= m.start() or not LOCAL_WORD.match(low, start):
            continue
        label = LABEL.match(low, m.end())
        dots = []
        while label:
            end = label.end()
            dot = LABEL_DOT.match(low, end)
            label = LABEL.match(low, dot.end()) if dot else None
            if label:
                dots.append((dot.start(), dot.end(), label.start(), label.end()))
        # a sentence may go on after the host: labels count up to the last that a host may end with
        spelt = m[0] == " at "
        while dots:
            a, b, x, y = dots[-1]
            ending = low[x:y]
            said = any(low[p:q] == LOCAL_DOT for p, q, _, _ in dots)
            loose = any(low[p:q] != "." for p, q, _, _ in dots)
            known = ending in ENDINGS or len(ending) == 2 and ending.isalpha()
            if low[a:b] == LOCAL_DOT and ending.isalnum() or known and text[x:y] == ending and low[a:b] in (".", " . ", " ."):
                break
            dots.pop()
        if not dots or not (spelt or loose or said or m[0] != "@"):
            continue
        if spelt and not said and (loose or low[start : m.start()] in PROSE):
            continue  # "at example . com" after plain words is prose
        done = dots[-1][3]
        inner, at = [], low.find(LOCAL_DOT, start, m.start())
        while at >= 0:
            inner.append((at, at + len(LOCAL_DOT), "."))
            at = low.find(LOCAL_DOT, at + len(LOCAL_DOT), m.start())
        changes += [*inner, (m.start(), m.end(), "@"), *((a, b, ".") for a, b, _, _ in dots)]
    return [(a, b, new) for a, b, new in changes if low[a:b] != new]


def deobfuscate(text: str) -> Rewritten | None:
    """None if no transducer applies."""
    found = None
    if not text.isascii() and ("\u00ad" in text or BEYOND_LATIN.search(text)):
        table, odd = letters()
        if not odd.isdisjoint(text):
            found = Rewritten(text.translate(table))
            found.replace([(m.start(), m.end(), "") for m in re.finditer(f"[{ZERO_WIDTH}]+", found.text)])
    low = _lower(found.text if found else text)

    def rewrite(changes: list[tuple[int, int, str]]) -> None:
        nonlocal found, low
        if changes:
            found = found or Rewritten(text)
            found.replace(changes)
            low = _lower(found.text)

    if DIGIT.search(low) and BESIDE_FIGURES.search(low):
        rewrite(_mixed(found.text if found else text, low))
    if TWO_WORDS.search(low):
        changes = []
        for m in SPELLED.finditer(low):
            words = list(ONE_WORD.finditer(low, m.start(), m.end()))
            changes += [(w.start(), words[i + 1].start() if i + 1 < len(words) else w.end(), DIGIT_WORDS[w[0]]) for i, w in enumerate(words)]
        rewrite(changes)
    if BRACKETED.search(low):
        rewrite([(m.start(), m.end(), "@") for m in BRACKET_AT.finditer(low)])
        rewrite([(m.start(), m.end(), ".") for m in BRACKET_DOT.finditer(low)])
    if FIGURE_DOT.search(low):
        rewrite([(m.start() + d.start(), m.start() + d.end(), ".") for m in IP_DOTS.finditer(low) if " dot " in m[0] or m[0].count(" . ") == 3 for d in SPACED_DOT.finditer(m[0]) if d[0] != "."])
    if " at " in low or "@" in low:
        rewrite(_disguised(found.text if found else text, low))
    return found


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all identifiers, in order."""
    base = detect(text)
    out = [(*x, True) for x in base]
    rewritten = deobfuscate(text)
    if rewritten:
        for s, kind, e in detect(rewritten.text):
            a, b = rewritten.first[s], rewritten.end[e - 1]
            if not any(k == kind and x < b and a < y and not (a < x or b > y) for x, k, y in base):
                out.append((a, kind, b, False))
    return sorted(set(out))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: the spans of each document, in order of start and kind."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in spans(t)] for t in part.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return arrow_map(texts, run, f"doc_id long, found {FOUND}")


def masked_text(text: str) -> str:
    """``text`` with each identifier as [KIND]; of overlapping spans the one that starts first, then the longest."""
    out, at = [], 0
    for s, k, e, _ in sorted(spans(text), key=lambda x: (x[0], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        elif e > at:
            at = e  # the rest of a span that overlaps one masked already
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, identifiers in ``text_col`` masked; null texts stay null."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        new = pa.array([None if t is None else masked_text(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
        return part.set_column(at, part.schema.field(at), new)

    return arrow_map(docs, run, schema)


def _matches(kind: int, pattern: str, keep: str) -> str:
    """SQL for the kept matches of a pattern with their places: pieces between matches tell where each begins."""
    return f"""SELECT doc_id, row, {kind} AS kind, m, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s
FROM (SELECT doc_id, row, found, pieces, unnest(found) AS m, generate_subscripts(found, 1) AS i FROM (SELECT doc_id, row, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS pieces FROM t) a) b WHERE {keep}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse({_DIGITS}), i, 1) AS INT) + 1] END)) % 10 = 0"
#: The base spans in SQL: what ``find`` tells without its transducers.
BASE_ORACLE = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
f AS ({_matches(0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
UNION ALL {_matches(1, "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255")}
UNION ALL {_matches(2, "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")}
UNION ALL {_matches(3, "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15")}),
g AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + length(m) AS VARCHAR), ',' ORDER BY s, kind) AS listed FROM f GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(listed, '')) AS base_sha256 FROM t LEFT JOIN g USING (row)
"""
