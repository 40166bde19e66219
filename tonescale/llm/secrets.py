"""Secrets in texts: fixed patterns, and an assignment-aware lexer.

The lexer reads the whole text as one stream of names, operators and literals (quoted, triple-quoted, in back
quotes, or quoted with a backslash inside another literal) and makes name-value pairs of it: ``name = "literal"``, ``name: literal``,
``"name": "literal"``, ``x["name"] = "literal"``, ``name := x``, ``name => x``, ``export NAME=x``, with a type behind the name
(``name: str = "literal"``, ``var name string = "literal"``) or without. What a literal holds is a stream of its own. A value is a literal,
another name, or several of them joined by ``+`` or ``.``; in parentheses they may follow each other and stand on several lines, and
a literal may stand on the line after its operator. Names that stand for literals are constants: they are propagated, through
other constants, to where they are used. A literal that reaches a target with a sensitive name
is scored by that name and by its own whole shape, and reported where the literal stands.

Texts are independent of each other: one pass, no shuffle. Defined results: a null or empty text
has no spans. Repeated rows and rows with a null id each get their own row. Other columns of the
input are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.llm.text import pieces, texts_of

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.ASCII | re.IGNORECASE
)
ASSIGN_LENGTH = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need not be matched
#: Kinds in the order in which spans with one start are listed. ``literal`` comes from the lexer.
KINDS = ("assign", "access", "hex", "literal")

#: A literal counts as a secret from this score on.
THRESHOLD = 0.5
MIN_LITERAL = 6

# Words of a name that make it sensitive, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "secrets": 0.9,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "authorization": 0.8, "bearer": 0.8, "pin": 0.6,
}
# Words that make "key" sensitive.
KEYED = {"api", "access", "private", "secret", "signing", "encryption", "master", "auth", "account", "license", "ssh"}
# Words after which a name describes a secret instead of holding it.
ABOUT = {
    "length", "len", "size", "count", "limit", "max", "min", "ttl", "expiry", "expires", "timeout", "type", "name", "path",
    "file", "url", "uri", "field", "label", "hint", "policy", "regex", "pattern", "prompt", "id", "index", "kind", "format",
}
PLACEHOLDER = re.compile(
    r"(?i)^(?:changeme|change_me|example.*|your[_-].*|xxx+|\*+|\.+|none|null|nil|true|false|undefined|todo|test|dummy|sample"
    r"|password|secret|token|string|<.*>|\[.*\]|\$\{.*\}|\$\(.*\)|%.*%|\{\{.*\}\})$"
)

# A literal in its quotes; an apostrophe within a word opens none.
_QUOTED = r"""
    \"\"\"(?P<ddd>(?:[^"\\]|\\.|"(?!""))*+)\"\"\" | \'\'\'(?P<sss>(?:[^'\\]|\\.|'(?!''))*+)\'\'\'
  | "(?P<d>(?:[^"\\\n]|\\.)*+)" | (?:(?<!\w)[rRbBuUfFL@]{1,2}|(?<![^\W_]))'(?P<s>(?:[^'\\\n]|\\.)*+)' | `(?P<b>[^`\n]*+)`
  | \\"(?P<e>[^"\\\n]*+)\\"
"""
_TARGET = r"[A-Za-z_$][\w$]*+(?:[.\-]++[\w$]++)*+"
_ASSIGNED = r":=|=>|\?\?=|\|\|=|[+?]=|=(?![=>])|:(?![:/=])"
_TOKEN = re.compile(
    rf"""
    \b(?:var|const)\s++(?P<declared>{_TARGET})\s++[*&\[\]]*+(?P<typed>{_TARGET})\s*+=(?!=)
  | (?P<name>{_TARGET})(?:[?!](?=\s*+:))?+\s*+(?P<operator>{_ASSIGNED})
  | (?:{_QUOTED})(?:[^\S\n]*+\]?+[^\S\n]*+(?P<behind>{_ASSIGNED}))?+
  | {_TARGET} | :: | \\.
    """,
    re.VERBOSE | re.DOTALL,
)
# A type between a colon and the equals sign.
_TYPE = r"[&*?]*+(?:mut\s++)?+[A-Za-z_][\w.]*+(?:::[\w.]++)*+(?:\[[\w\s,.|&*\[\]]*\]|<[\w\s,.|&*<>]*>)*+\??+"
_TYPED = re.compile(rf"\s*+{_TYPE}(?:\s*+\|\s*+{_TYPE})*+\s*+=(?![=>])")
_OPEN = re.compile(r"[^\S\n]*+(?:\\?\n\s*+)?+(?P<open>(?:\(\s*+)*+)")
# An unquoted value: ``=`` is part of it at its end only; the narrow form, within another value, ends at a colon too.
_BARE = r"""(?P<bare>[^\s"'`,;(){{}}\[\]+\\={0}]++(?:=++(?![\w"']))?+)"""
_PART, _NARROW = (
    re.compile(rf"""\s*+(?:(?:[rRbBuUfFL@]{{1,2}}(?=["']))?(?:{_QUOTED})|{_BARE.format(end)})""", re.VERBOSE | re.DOTALL) for end in ("", ":")
)
_JOIN = re.compile(r"[^\S\n]*+(?:\+|\.\s)")
_JOIN_OPEN = re.compile(r"\s*+(?:\+|\.\s)?+")
_BEHIND = re.compile(r"[^\S\n]*+[:=]")
_KEY = re.compile(rf"{_TARGET}\Z")
# What sensitive targets look like, whatever else their names have: texts without one need no lexing.
_STEM = re.compile("(?i)pass|pwd|secret|token|key|credential|authorization|bearer|pin")
_WORD = re.compile(r"""[\w$.\-]++(?P<target>(?:\\?["'`][^\S\n]*+\]?+|[?!])?+(?:\s*+[:=+?|]|\s++[*&\[\]]*+[\w$.\-]++\s*+=))?+""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_$][\w$.]*\Z")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    value_start: int
    value_end: int
    score: float
    name: str


def name_score(name: str) -> float:
    """How likely a target of this name holds a secret, from the words of the name."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    score = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if words[-1] in ("key", "keys") and KEYED & set(words):
        score = 1.0
    return max(score, max((SENSITIVE.get(a + b, 0.0) for a, b in zip(words, words[1:])), default=0.0))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: its length, the variety of its characters, no placeholder."""
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value):
        return 0.0
    counts = Counter(value)
    n = sum(counts.values())
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    spaces = value.count(" ")
    return max(0.0, min(1.0, bits / 3.5) * min(1.0, len(value) / 8) * (0.6 + 0.1 * classes) - 0.2 * spaces)


def _parts(text: str, at: int, part: re.Pattern) -> list[tuple[str, str, int, int]]:
    """What the value at a place consists of: ``(literal or name or reference or bare or word, text, start, end)``."""
    opened = _OPEN.match(text, at)
    inside, below = bool(opened["open"]), "\n" in opened[0]
    found, at = [], opened.end()
    while m := part.match(text, at):
        kind = m.lastgroup
        value, start, end = m[kind], m.start(kind), m.end(kind)
        if kind != "bare":
            if below and not inside and _BEHIND.match(text, m.end()):
                break  # the next line is an assignment of its own
            kind = "literal"
        elif inside or below:
            # In parentheses only quoted literals and constants count, and on the next line only literals.
            if below and not inside or not _NAME.match(value):
                break
            kind = "reference"
        else:
            # Unquoted, a literal has a digit in it; else it is a name, a call or a plain word.
            plain = not any(c.isdigit() for c in value) or text[m.end() : m.end() + 1] == "("
            kind = "name" if _NAME.match(value) else "word" if plain else "bare"
        found.append((kind, value, start, end))
        joined = (_JOIN_OPEN if inside else _JOIN).match(text, m.end())
        if not joined:
            break
        at = joined.end()
    return found


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """Name and value parts of every assignment, with offsets in the text."""
    # Streams to read: the text, then what the literals in it hold.
    todo = [(0, text)]
    while todo:
        first, stream = todo.pop()
        within = 0  # where the last value ends
        for m in _TOKEN.finditer(stream):
            names, at = [], m.end()
            if m["declared"]:
                names = [m["declared"], m["typed"]]
            elif m["name"]:
                names = [m["name"]]
            elif m.lastgroup:
                kind = next(k for k in ("ddd", "sss", "d", "s", "b", "e") if m[k] is not None)
                held = m[kind]
                if m["behind"] and _KEY.match(held):
                    names = [held]
                elif "=" in held or ":" in held:
                    todo.append((first + m.start(kind), held))
            if not names:
                continue
            if (m["operator"] or m["behind"]) == ":" and (typed := _TYPED.match(stream, at)):
                at = typed.end()
            parts = _parts(stream, at, _NARROW if at < within else _PART)
            if parts:
                within = max(within, parts[-1][3])
                parts = [(k, v, first + s, first + e) for k, v, s, e in parts]
                for name in names:
                    yield name, parts


def lexed(text: str) -> list[Span]:
    """Literals that reach a target with a sensitive name."""
    if not _STEM.search(text) or not any(m["target"] and _STEM.search(m[0]) for m in _WORD.finditer(text)):
        return []
    assigned = list(pairs(text))
    scored = [(name, parts, name_score(name.rpartition(".")[2])) for name, parts in assigned]
    if not any(s for _, _, s in scored):
        return []
    constants: dict[str, list[list[tuple[str, str, int, int]]]] = {}
    for name, parts, _ in scored:
        constants.setdefault(name, []).append(parts)
    found: dict[tuple[int, int], Span] = {}
    for name, parts, sensitive in scored:
        if not sensitive:
            continue
        # Every name is followed once, so constants that refer to each other end.
        todo, seen = [parts], {name}
        while todo:
            now = todo.pop()
            literals = [
                (v, s, e)
                for k, v, s, e in now
                if k in ("literal", "bare") or k == "name" and v not in constants and any(c.isdigit() for c in v)
            ]
            whole = "".join(v for v, _, _ in literals)
            score = sensitive * literal_score(whole)
            if score >= THRESHOLD:
                for v, s, e in literals:
                    if v:
                        old = found.get((s, e))
                        if old is None or old.score < score:
                            found[s, e] = Span("literal", s, e, s, e, round(score, 4), name)
            for k, v, _, _ in now:
                if k in ("name", "reference") and v in constants and v not in seen:
                    seen.add(v)
                    todo += constants[v]
    return list(found.values())


def find(text: str | None) -> list[Span]:
    """All spans of a text, ordered by start and kind."""
    if not text:
        return []
    found = []
    assigns = "=" in text or ":" in text
    if assigns:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
                found.append(Span("assign", m.start(), m.end(), m.start(2), m.end(2), 1.0, m.group(1)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LENGTH:
                found.append(Span("access", m.start(), m.end(), m.start(), m.end(), 1.0, ""))
    for m in HEX.finditer(text):
        found.append(Span("hex", m.start(), m.end(), m.start(), m.end(), 1.0, ""))
    if assigns:
        found += lexed(text)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with the value of every span replaced; values that overlap become one mark."""
    out, at = [], 0
    for start, end in sorted((s.value_start, s.value_end) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN_TYPE = "kind string, start long, `end` long, value_start long, value_end long, score double, name string"


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_column, spans)``: every row with the array of its spans."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    spans = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()),
        ("value_end", pa.int64()), ("score", pa.float64()), ("name", pa.string()),
    ]))

    def run(batches):
        for batch in pieces(batches, 1):
            found = [[vars(s) for s in find(t)] for t in texts_of(batch.column(1)).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, spans)], ["id", "spans"])

    found = rows.mapInArrow(run, f"id {id_type}, spans array<struct<{SPAN_TYPE.replace(' string', ':string').replace(' long', ':long').replace(' double', ':double')}>>")
    return found.withColumnRenamed("id", id_column)


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    found = find_secrets(docs)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns; secrets in the text are replaced, and ``length`` follows. A null text stays null."""
    # Rows go through whole, in the order of their columns: names may repeat or clash.
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches):
        for batch in pieces(batches, at):
            old = batch.column(at).to_pylist()
            new = [redacted(t, s) if t and (s := find(t)) else t for t in old]
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    done = docs.mapInArrow(run, schema)
    if length in docs.columns:
        done = done.withColumn(length, F.when(F.col(length).isNotNull(), F.char_length(text).cast(schema[length].dataType)))
    return done
