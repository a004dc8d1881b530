"""Secret scanning by assignment-aware lexing.

Three base patterns find secrets wherever they stand.  A lexer also parses
source and configuration syntax into pairs of a name and a literal, carries
constants to the names that they are assigned to, and scores each literal by how
sensitive a name it ends in and how random it is; literals that score high are
spans of the kind `literal`, unless a base span holds them.

What the lexer reads as a pair: assignments with = := => : and type annotations;
quoted strings with prefixes, triple quotes, parenthesised, concatenated or on
the next line; defaults after `or`, ||, ?? and ?:, and as a look-up's second
argument; setters and calls that put a value under a name; YAML block scalars;
XML elements, and attributes that name a value; #define; schemes of
authorization; passwords in addresses.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.shared import Batches, in_arrow, lean
from weftgraph.llm.shingles import slices

#: The base kinds, in order, their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "literal"]
ASSIGN_CHARS = 6

#: How sensitive a name is by the words in it, joined without separators.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.9, "credentials": 0.9, "authorization": 0.8,
    "bearer": 0.8, "connectionstring": 0.7, "clientsecret": 1.0, "auth": 0.6, "salt": 0.6, "cookie": 0.5, "session": 0.5, "key": 0.4,
}
#: A literal made of these words alone stands for a secret but is none.
FILLERS = frozenset(
    "access actual add and any api apikey bar baz change changeme client credential credentials db default dummy dev empty enter example fake fill foo goes here hidden insert is in it key left like local me "
    "mock my name new no none not null of on or pass passwd password placeholder please private provide put pwd random real redacted removed replace replaceme sample secret set some something string super test "
    "testing that the this to todo token undefined unset use user value vault var with x xx xxx xxxx your yours".split()
)
#: Shapes of texts that stand for a secret.
PLACEHOLDER = re.compile(r"(?:x+|X+|\*+|\.+|-+|_+|0+|<.*>|\$\{.*\}|\$\(.*\)|\{\{.*\}\}|%\(.*\)s|%[A-Za-z_]+%|\[.*\])", re.DOTALL)
#: Least characters and bits of a literal, and the least score that makes a span.
LITERAL_CHARS, LITERAL_BITS, LEAST_SCORE = 8, 24.0, 0.5
MASK = "[SECRET]"

_OPERATOR = re.compile(r"[:=]")
_NAME = re.compile(r"[A-Za-z0-9_.$-]")
#: A literal: a string with any prefix in triple quotes or quotes, or a bare word.
_STRING = r"""(?:[rRbBfFuUL@$]{0,2})(?:(?P<triple>\"{3}|'{3})(?P<long>.*?)(?P=triple)|(?P<quote>["'`])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote))"""
_BARE = r"(?P<bare>[A-Za-z0-9+/_.$=-]+)"
_SCHEME = r"(?:(?:Bearer|Basic|Token)[ \t]+(?=[A-Za-z0-9+/_.=-]{8}))?"
_RIGHT = re.compile(rf"(?::=|=>|=|:)[ \t]*(?P<open>\([ \t\r\n]*)?(?:{_STRING}|{_SCHEME}{_BARE})", re.DOTALL)
#: A value on the next line stands alone there, and is set in.
_NEXT_LINE = re.compile(rf"(?::=|=>|=|:)[ \t]*\\?\r?\n[ \t]+(?:{_STRING}|{_BARE})[ \t]*[;,]?[ \t]*(?=\r?\n|$)", re.DOTALL)
_BLOCK = re.compile(r":[ \t]*[|>][+-]?[0-9]?[+-]?[ \t]*\r?\n")
#: What may stand between a reference and what comes after it: indices and the arguments of a call.
_SUFFIX = re.compile(r"(?:\[[^\[\]\n]*\]|\([^()\n]*\)|\?\.|->|\.[A-Za-z_$][A-Za-z0-9_$]*)*")
_JOINS = r"(?:\+|\.\.|\.|&|\|\||\?\?|\?:|\bor\b|\belse\b)"
_OR = re.compile(r"[ \t\r\n]*(?:\|\||\?\?|\?:|or\b)")
_MORE = re.compile(rf"[ \t]*{_JOINS}[ \t]*(?:{_STRING}|(?P<bare>[A-Za-z_$][A-Za-z0-9_.$]*))", re.DOTALL)
_MORE_INSIDE = re.compile(rf"[ \t\r\n]*(?:{_JOINS}[ \t\r\n]*)?{_STRING}(?P<bare>\b\B)?", re.DOTALL)
_ANNOTATED = re.compile(r":[ \t]*[A-Za-z_$][A-Za-z0-9_.$]*(?:\[[^\[\]\n]*\]|<[^<>\n]*>)?[ \t]*(?:\|[ \t]*[A-Za-z_]+[ \t]*)?(?==(?!=))")
#: A look-up with a default: the last string among the arguments.
_DEFAULT = re.compile(r"""(?:\.|_|^)(?:get|getenv|getProperty|setdefault|env|getString|get_or_default|getOrDefault|property)[ \t]*\([ \t]*[^()\n]*?,[ \t]*(?:default[ \t]*=[ \t]*)?(?P<quote>["'`])(?P<quoted>[^"'`\\\n]*)(?P=quote)[ \t]*\)""")
#: Calls that put one value under their own name, or a value under the name before it.
_SETTER = re.compile(r"""(?P<name>(?:[A-Za-z_$][A-Za-z0-9_$]*\.)*(?:set|with|use|add)[A-Z_][A-Za-z0-9_]*)\([ \t\r\n]*(?P<quote>["'`])(?P<value>[^"'`\\\n]*)(?P=quote)[ \t\r\n]*\)""")
_PUT = re.compile(r"""(?:set|put|add|with|define|header|append|insert|export|setdefault|environ|config|property)[A-Za-z_]*\([ \t\r\n]*(?P<q>["'`])(?P<name>[A-Za-z0-9_. -]{1,100})(?P=q)[ \t]*,[ \t\r\n]*(?P<quote>["'`])(?P<value>[^"'`\\\n]*)(?P=quote)""", re.IGNORECASE)
_DEFINE = re.compile(r"""#[ \t]*define[ \t]+(?P<name>[A-Za-z_][A-Za-z0-9_]*)[ \t]+(?P<quote>["']?)(?P<value>[^"'\s]+)(?P=quote)""")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:-]*)(?:[ \t\r\n][^<>]*)?>[ \t\r\n]*(?P<value>[^<>\s]+)[ \t\r\n]*</(?P=name)[ \t\r\n]*>")
_TAG = re.compile(r"<[A-Za-z_][^<>]*>")
_ATTRIBUTE = re.compile(r"""\b(?P<key>name|key|id|value|content)[ \t]*=[ \t]*(?P<quote>["'])(?P<value>[^"'<>]*)(?P=quote)""", re.IGNORECASE)
_ADDRESS = re.compile(r"://[^\s:/@\"'<>]*:(?P<value>[^\s:/@\"'<>]+)@")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_LETTERS = re.compile(r"[A-Za-z]+|[0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*")


@lru_cache(65536)
def sensitivity(name: str) -> float:
    """The weight of the most sensitive run of words in a name such as dbPassword or AWS_SECRET_KEY."""
    words = [w.lower() for w in _WORDS.findall(name)]
    runs = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + 3, len(words)) + 1)}
    return max((SENSITIVE.get(r, 0.0) for r in runs), default=0.0)


def bits(value: str) -> float:
    """Shannon entropy of the characters, times their number."""
    n = len(value)
    return -sum(c * math.log2(c / n) for c in Counter(value).values())


def filler(value: str) -> bool:
    """Whether a whole literal stands for a secret and is none: nothing but filling words, or a shape of its own."""
    return bool(PLACEHOLDER.fullmatch(value)) or all(w.isdigit() and len(w) < 4 or w.lower() in FILLERS for w in _LETTERS.findall(value))


Pair = tuple[str, list[tuple[int, int]], list[str], bool]


def _inside(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of the lines of a long string, without the blanks around them."""
    return [(a + m.start(), a + m.end()) for m in re.finditer(r"\S(?:[^\n]*\S)?", text[a:b])]


def _block(text: str, at: int, name_at: int) -> list[tuple[int, int]]:
    """Spans of the lines from `at` on that are set in further than the line of the name."""
    line = text.rfind("\n", 0, name_at) + 1
    depth = len(text[line:name_at]) - len(text[line:name_at].lstrip(" -"))
    found = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        row = text[at:end]
        if row.strip():
            if len(row) - len(row.lstrip(" ")) <= depth:
                break
            found += _inside(text, at, end)
        at = end + 1
    return found


def _assignments(text: str) -> Iterator[tuple[int, Pair]]:
    """Place, name, spans of the literals, names that are referred to, and whether anything is quoted, of assignments in order."""
    done, annotated = 0, (-1, "")
    for m in _OPERATOR.finditer(text):
        at = m.start()
        if at < done or at and text[at - 1] in "!<>=:" or text[at + 1 : at + 2] == m[0] or text.startswith("://", at):
            continue
        end = at
        while end and text[end - 1] in " \t":
            end -= 1
        if end and text[end - 1] in "\"'`]":
            end -= 1
            if end and text[end - 1] in "\"'`":
                end -= 1
        start = end
        while start and _NAME.match(text, start - 1):
            start -= 1
        name = text[start:end]
        if annotated[0] == at:
            name = annotated[1]
        if not name:
            continue
        typed = _ANNOTATED.match(text, at)
        if typed and m[0] == ":":
            annotated, done = (typed.end(), name), typed.end()
            continue
        block = _BLOCK.match(text, at)
        if block:
            lines = _block(text, block.end(), start)
            if lines:
                done = lines[-1][1]
                yield start, (name, lines, [], True)
            continue
        right = _RIGHT.match(text, at) or _NEXT_LINE.match(text, at)
        if not right:
            continue
        literals, references, quoted = [], [], False
        inside = "open" in right.re.groupindex and right["open"]
        part: re.Match[str] | None = right
        while part:
            done = part.end()
            if part["triple"]:
                literals += _inside(text, *part.span("long"))
                quoted = True
            elif part["quote"]:
                literals.append(part.span("quoted"))
                quoted = True
            elif _IDENTIFIER.fullmatch(part["bare"]):
                references.append(part["bare"])
                if part is right:
                    literals.append(part.span("bare"))
                suffix = _SUFFIX.match(text, done)
                default = _DEFAULT.search(text, part.start("bare"), suffix.end())
                if default:
                    literals, quoted = [default.span("quoted")], True
                done = suffix.end()
            else:
                literals.append(part.span("bare"))
            part = (_MORE_INSIDE if inside else _MORE).match(text, done)
            if part and part["quote"] and references and _OR.match(text, done):
                # A default is worth what the reference names that it stands in for.
                yield done, (references[-1], [part.span("quoted")], [], True)
        if quoted:
            # Beside a quoted default, the reference that it stands in for is no literal.
            literals = [x for x in literals if text[x[0] : x[1]] not in references]
        yield start, (name, literals, references, quoted)


def pairs(text: str) -> Iterator[Pair]:
    """Name, spans of the literals, names that are referred to, and whether anything is quoted, in order of place."""
    found = list(_assignments(text))
    for pattern in (_SETTER, _PUT, _DEFINE, _ELEMENT):
        found += [(m.start(), (m["name"], [m.span("value")], [], True)) for m in pattern.finditer(text)]
    found += [(m.start(), ("password", [m.span("value")], [], True)) for m in _ADDRESS.finditer(text)]
    for tag in _TAG.finditer(text):
        said = {m["key"].lower(): m for m in _ATTRIBUTE.finditer(text, tag.start(), tag.end())}
        name, value = next((said[k] for k in ("key", "name", "id") if k in said), None), said.get("value") or said.get("content")
        if name and value:
            found.append((tag.start(), (name["value"], [value.span("value")], [], True)))
    found.sort(key=lambda x: x[0])
    return (pair for _, pair in found)


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose target, direct or through constants, is sensitive enough for how random they are."""
    latest: dict[str, int] = {}
    nodes: list[tuple[list[tuple[int, int]], list[int]]] = []
    weights: list[float] = []
    for name, literals, references, quoted in pairs(text):
        known = [latest[r] for r in references if r in latest]
        if not quoted:
            # A bare word is a reference where it is known, else a literal if it holds a digit.
            literals = [s for s in literals if not known and any(c.isdigit() for c in text[s[0] : s[1]])]
        latest[name] = len(nodes)
        nodes.append((literals, known))
        weights.append(sensitivity(name))
    best: dict[tuple[int, int], float] = {}
    # A constant is assigned before it is used, so one pass backwards carries every weight to its source.
    for i in range(len(nodes) - 1, -1, -1):
        for k in nodes[i][1]:
            weights[k] = max(weights[k], weights[i])
        if weights[i]:
            best |= {s: weights[i] for s in nodes[i][0]}
    out = []
    for (a, b), weight in sorted(best.items()):
        value = text[a:b]
        if len(value) < LITERAL_CHARS or any(c.isspace() for c in value) or filler(value):
            continue
        if weight * min(1.0, bits(value) / LITERAL_BITS) >= LEAST_SCORE and bits(value) >= LITERAL_BITS / 2:
            out.append((a, b))
    return out


def find(text: str | None) -> list[tuple[str, int, int, int]]:
    """Spans as kind, start, end and where the secret itself starts, by start and then kind as listed."""
    text = text or ""
    found = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    found += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b, _ in found)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for a, b in literal_spans(text):
        i = bisect_right(starts, a)
        if not i or reach[i - 1] < b:
            found.append(("literal", a, b, a))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def told(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs (doc_id, text).

    Positions are code points, ends exclusive.  A base span is the whole match,
    its name included.  A null or empty text has no spans; the digest is then
    that of nothing.  Long texts are read whole, in time that grows with their
    length.  Spans that begin at the same place come in the order of their kinds.
    Repeated rows give equal rows, null doc_ids are kept, columns other than doc_id
    and text are ignored, and an empty table gives none.
    """
    from pyspark.sql import functions as F

    @lean
    def over(batches: Batches) -> Batches:
        for batch in batches:
            n, digests, spans = {k: [] for k in KINDS[:3]}, [], []
            for text in batch.column(1):
                found = find(text.as_py())
                base = [x for x in found if x[0] != "literal"]
                for k in n:
                    n[k].append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n[k], pa.int64()) for k in n), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(over, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with each secret, but not the name before it, replaced; overlapping ones together."""
    out, at = [], 0
    for a, b in sorted((secret, end) for _, _, end, secret in find(text)):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with all its columns, secrets masked in text; n_chars, where there is one, follows a changed text.

    Null and empty texts stay as they are, long ones are read whole.  Repeated rows
    and null doc_ids are kept, an empty table gives none, and other columns, whatever
    their names, are passed on.
    """
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def over(batches: Batches) -> Batches:
        for batch in batches:
            # A slice at a time, so that texts stand several times over in memory for a slice only.
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                old = part.column(at).to_pylist()
                new = [x and masked(x) for x in old]
                cols = list(part.columns)
                cols[at] = pa.array(new, pa.string())
                if length is not None:
                    kept = part.column(length).to_pylist()
                    cols[length] = pa.array([k if x == y else len(y) for k, x, y in zip(kept, old, new, strict=True)], part.column(length).type)
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return in_arrow(docs, over)
