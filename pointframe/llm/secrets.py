"""Secret scan: pattern kinds, and an assignment-aware lexer that reads names, follows constants and scores literals.

Pattern kinds (assign, access, hex) are found in the whole text, leftmost and non-overlapping within a kind. The
lexer reads assignments in the syntaxes of source code and configuration files: name-literal pairs
(`name = "x"`, `$name = "x"`, `a["name"] = "x"`, `name: x`, `"name": "x"`, `name := x`, `name => x`,
`key="name" value="x"`), sums of literals, and references (`name`, `$name`, `${name}`, `a["name"]`) to names assigned
before, whose literals are carried along. A value or the rest of a sum may stand on the next line or in brackets; of a
string or block over several lines each line is a literal. A word before `(` is a callee and no literal, but the strings among its
arguments go on to the name, as do those of a list, and both branches of a choice; a string that names constants (`f"{x}"`,
`"${x}"`) hands on theirs. Several targets take their values in order (`a, b = "x", "y"`). Setters (`setName("x")`,
`put("name", "x")`), `#define name x`, `<name>x</name>` and `--name x` are pairs too. A literal that
reaches a name is scored by how sensitive the name is and how much the literal looks like key material; a literal of
a score of at least `threshold` becomes a span of kind `literal`, if no assign span covers it already. Literals with
white space, as pass phrases of several words, score 0: they can't be told from prose.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import append_columns, claim, read_documents

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5

#: How sensitive the words of a name are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8,
    "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "private": 0.7, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "signature": 0.6,
    "key": 0.6, "salt": 0.6, "cookie": 0.6, "session": 0.5, "cert": 0.5, "dsn": 0.6, "webhook": 0.6,
}
#: Words that make a name harmless, and literals that stand for nothing.
HARMLESS = {"public", "count", "length", "size", "max", "min", "limit", "type", "name", "file", "path", "field", "label", "id", "url", "expiry", "ttl", "timeout"}
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\{\{.*\}\}|change_?me.*|your.*|example.*|placeholder.*|todo.*|none|null|true|false|undefined|test|dummy.*|sample.*|redacted.*)$")

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_OP = re.compile(r"[=:]")
_PAIR = re.compile(rf"""(?<![\w.\-$])(?:"({_NAME})"|'({_NAME})'|(?:[$@]{{1,2}}(?:\w+:(?=[A-Za-z_]))?)?({_NAME}))(?:\x20?[\]}}])?(?:\x20*:\x20*[A-Za-z_][\w\[\], ]*+(?==))?[\x20\t]*(?::=|=>|=(?!=)|:(?![:/]))[\x20\t]*""")
_ATOM = re.compile(rf"""[\x20\t]*(?:(?:(?P<f>[A-Za-z]{{1,2}})(?=["']))?(?P<q>["'`])(?P<s>(?:\\.|(?!(?P=q)).)*)(?P=q)|\$\{{(?P<i>{_NAME})\}}|[$@]?[A-Za-z_][\w.]*\[["'](?P<k>{_NAME})["']\]|\$(?P<d>[A-Za-z_]\w*)|(?P<b>[^\s"'`,;(){{}}\[\]+]+))""")
_TRIPLE = re.compile(r"""[\x20\t]*[A-Za-z]{0,2}(?P<q>"{3}|'{3}|`{3})(?P<s>(?s:.*?))(?P=q)""")
_LONG = re.compile(r"""[\x20\t]*(?:(?P<f>[A-Za-z]{1,2})(?=["']))?(?P<q>["'`])(?P<s>(?s:\\.|(?!(?P=q))[^\\])*+)(?P=q)""")
_BLOCK = re.compile(r"[\x20\t]*[|>][+\-0-9]*[\x20\t]*\r?(?=\n)")
_PLUS = re.compile(r"(?:[\x20\t]*|[\x20\t]*\\?\r?\n[\x20\t]+)(?:\+|\.\.)[\x20\t]*(?:\\?\r?\n[\x20\t]*(?=\S))?")
_BRACKET = re.compile(r"[\x20\t]*\([\x20\t]*")
_NEXT = re.compile(r"[\x20\t]*\\?\r?\n[\x20\t]*")
_ALONE = re.compile(r"""(?<=[\x20\t])[^\s"'`,;(){}\[\]+=]*[^\s"'`,;(){}\[\]+=:][;,]?[\x20\t]*\r?(?:\n|\Z)""")
_KEY = re.compile(r"[\x20\t]*(?:[\]}][\x20\t]*)?[:=]")
_BESIDE = re.compile(r"""(?:[\x20\t]*\r?\n)?[\x20\t]*(?=["'])""")
_LINES = re.compile(r"\S(?:[^\n]*\S)?")
_LIST = re.compile(r"[\x20\t]*[\[{][\x20\t]*")
_ITEM = re.compile(rf"""[^\w"'`()\[\]{{}};$@]*(?:(?:(?P<f>[A-Za-z]{{1,2}})(?=["']))?(?P<q>["'`])(?P<s>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q)|(?P<b>[$@]?\w[\w.]*)|(?P<o>[(\[{{])|(?P<c>[)\]}};])|.)""")
_CHOICE = re.compile(r"""[\x20\t]*(?:[=!<>&|]{1,3}[^\n"'?;=:,]*)?\?(?![?.:])[\x20\t]*""")
_ELSE = re.compile(r"""[\x20\t]*(?:(?P<or>\?\?|\|\||or\b)|(?P<colon>:(?=[\x20\t]))|(?P<if>if\b[^\n"'=:;]*\belse\b))[\x20\t]*""")
_INSIDE = re.compile(rf"\$?\{{({_NAME})\}}|\$([A-Za-z_]\w*)")
_TARGETS = re.compile(rf"(?:^|[;{{])[\x20\t]*(?:(?:let|const|var|my|local)\b)?[\x20\t]*((?:[$@]?{_NAME}[\x20\t]*,[\x20\t]*)+)$")
_COMMA = re.compile(r"[\x20\t]*,[\x20\t]*(?:\\?\r?\n[\x20\t]*)?")
#: Pairs that have no sign of assignment, by what stands before the value.
_SETTER = re.compile(r"(?<![A-Za-z0-9])[sS]et(?:_(?=\w)|(?=[A-Z]))(?P<name>\w+)\(\s*")
_PUT = re.compile(rf"""(?<![A-Za-z])(?i:set|put|add|define|append|header|get|getenv|setenv|putenv|setdefault|(?:set|get)_?(?:property|item|header|attribute|env|value))\s*\(\s*["'](?P<name>{_NAME})["']\s*,\s*""")
_DEFINE = re.compile(rf"(?m)^[\x20\t]*[#%][\x20\t]*define[\x20\t]+(?P<name>{_NAME})[\x20\t]+")
_FLAG = re.compile(r"(?<![\w\-])--(?P<name>[A-Za-z][\w\-]*)(?:=|[\x20\t]+)(?![\-=])")
_ELEMENT = re.compile(rf"<({_NAME})(?:\s[^<>]*)?>[\x20\t]*([^<>\s](?:[^<>\n]*[^<>\s])?)[\x20\t]*</\1\s*>")
_SIGNS = re.compile(r"[:=(]|--|</|define")
_XML = re.compile(r"""(?:key|name)\s*=\s*["']([^"'\n]+)["']\s+value\s*=\s*["']([^"'\n]*)["']""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def name_score(name: str) -> float:
    """How sensitive a target name is, from 0 to 1: its most telling word, less if a harmless word ends it."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words:
        return 0.0
    joined = "".join(words)
    best = max([SENSITIVE.get(w, 0.0) for w in words] + [1.0 if "apikey" in joined or "accesskey" in joined or "privatekey" in joined else 0.0])
    return best * (0.3 if words[-1] in HARMLESS or "public" in words else 1.0)


def literal_score(value: str) -> float:
    """How much a literal looks like key material, from 0 to 1: its entropy, length and mix of characters."""
    return _score(len(value), value, value) if len(value) >= 8 else 0.0


def _score(n: int, chars: str | Counter, outline: str) -> float:
    """The score of n characters, given with their counts; outline is the value or has the same placeholder pattern."""
    if n < 8 or PLACEHOLDERS.match(outline) or any(c.isspace() for c in chars):
        return 0.0
    counts = Counter(chars)
    bits = -sum(k / n * math.log2(k / n) for k in counts.values())
    classes = sum(any(test(c) for c in counts) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    if classes < 2 or not any(c.isdigit() for c in counts) and classes < 3:
        return 0.0
    return min(1.0, bits / 3.5) * min(1.0, 0.6 + n / 40)


EDGE = 32  # characters of a long joined value's ends that tell whether it is a placeholder


@dataclass(eq=False)
class Flow:
    """What a name holds: literals (start, end, value) and the flows of other names, shared rather than copied."""

    parts: list[tuple[int, int, str] | Flow] = field(default_factory=list)
    summed: tuple[int, Counter, str, str] | None = None  # number of literals, characters of the joined value, its ends

    def summary(self) -> tuple[int, Counter, str, str]:
        todo = [self]
        while todo:
            flow = todo[-1]
            below = [p for p in flow.parts if isinstance(p, Flow) and p.summed is None]
            if flow.summed is None and below:
                todo += below
                continue
            todo.pop()
            if flow.summed is None:
                many, counts, head, tail = 0, Counter(), "", ""
                for p in flow.parts:
                    n, c, h, t = p.summed if isinstance(p, Flow) else (1, Counter(p[2]), p[2][:EDGE], p[2][-EDGE:])
                    many += n
                    counts.update(c)
                    head, tail = (head + h)[:EDGE] if len(head) < EDGE else head, (tail + t)[-EDGE:]
                flow.summed = many, counts, head, tail
        return self.summed

    def whole(self) -> float:
        """The score of the joined value of several literals, without joining it."""
        many, counts, head, tail = self.summary()
        n = sum(counts.values())
        outline = head + "".join(counts) + tail if n > EDGE else head
        return _score(n, counts, outline) if many > 1 else 0.0


def _reach(events: list[tuple[float, int, str, Flow]]) -> dict[tuple[int, int], tuple[float, int, str, str]]:
    """Of each literal (start, end) the best event that reaches it, the first of equals: (score, order, name, value)."""
    best: dict[tuple[int, int], tuple[float, int, str, str]] = {}
    seen: set[int] = set()
    for s, order, name, flow in sorted(events, key=lambda x: (-x[0], x[1])):
        todo = [flow]
        while todo:
            at = todo.pop()
            if id(at) in seen:
                continue
            seen.add(id(at))
            for p in at.parts:
                if isinstance(p, Flow):
                    todo.append(p)
                else:
                    best.setdefault((p[0], p[1]), (s, order, name, p[2]))
    return best


def _items(text: str, pos: int, env: dict[str, Flow], stop: int) -> list[tuple[int, int, str] | Flow]:
    """The strings, and what known names hold, from pos to the end of the bracket that it is in, to the next named value there, or to stop."""
    literals: list[tuple[int, int, str] | Flow] = []
    depth = 1
    while pos < stop and (m := _ITEM.match(text, pos)) is not None:
        pos = m.end()
        if m["o"]:
            depth += 1
        elif m["c"]:
            depth -= 1
            if not depth or m["c"] == ";":
                break
        elif m["q"]:
            if _KEY.match(text, pos):
                break
            literals += _string(text, m, env)
        elif m["b"] and text[pos : pos + 1] != "(":
            if _KEY.match(text, pos):
                break
            literals += [env[x]] if (x := m["b"].lstrip("$@")) in env else []
    return literals


def _string(text: str, m: re.Match, env: dict[str, Flow]) -> list[tuple[int, int, str] | Flow]:
    """The literals of a matched string, a line each, and what the constants named in it hold."""
    at, s = m.start("s"), m["s"]
    out: list[tuple[int, int, str] | Flow] = [(at + x.start(), at + x.end(), x[0]) for x in _LINES.finditer(s)] if "\n" in s else [(at, m.end("s"), s)]
    if "{" in s or "$" in s:
        known = [env[n] for x in _INSIDE.finditer(s) if (n := x[1] or x[2]) in env and ("$" in x[0] or "f" in (m.groupdict().get("f") or "").lower())]
        if known and not _INSIDE.sub("", s).strip():
            return known
        out += known
    return out


def _value(text: str, pos: int, env: dict[str, Flow], stop: int) -> tuple[int, list[tuple[int, int, str] | Flow] | None]:
    """(where to go on, literals) of the value at pos, which may begin on the next line; None if a line ends without any."""
    literals: list[tuple[int, int, str] | Flow] = []
    if (m := _BLOCK.match(text, pos)) is not None:
        return _block(text, pos, m.end())
    if (m := _LIST.match(text, pos)) is not None:
        return m.end(), _items(text, m.end(), env, stop)
    bracket = _BRACKET.match(text, pos)
    pos = bracket.end() if bracket else pos
    if (m := _NEXT.match(text, pos)) is not None:
        # A quoted string that is no key itself, or a word alone on an indented line.
        pos, quoted = m.end(), text[m.end() : m.end() + 1] in {'"', "'", "`"}
        a = quoted and (_TRIPLE.match(text, pos) or _ATOM.match(text, pos) or _LONG.match(text, pos))
        if not (a and _KEY.match(text, a.end()) is None or not quoted and (_TRIPLE.match(text, pos) or _ALONE.match(text, pos))):
            return pos, None
    elif pos >= len(text):
        return pos, None
    if bracket and text[pos : pos + 1] in {'"', "'"} and not _TRIPLE.match(text, pos):
        return pos, _items(text, pos, env, stop)
    choice = False
    while (a := _TRIPLE.match(text, pos) or _ATOM.match(text, pos) or _LONG.match(text, pos)) is not None:
        found = a.groupdict()
        ref = found.get("i") or found.get("d") or found.get("k")
        word, pos = None, a.end()
        if found.get("q"):
            literals += _string(text, a, env)
        elif ref or a["b"].lstrip("@") in env:
            literals += [env[x]] if (x := ref or a["b"].lstrip("@")) in env else []
        elif text[pos : pos + 1] == "(":  # a callee
            return pos + 1, literals + _items(text, pos + 1, env, stop)
        else:
            end = pos - (a["b"][-1] in ".:")
            word = (a.start("b"), end, text[a.start("b") : end])
        if (m := _CHOICE.match(text, pos)) is not None:  # what was read is the condition
            literals, choice, pos = [], True, m.end()
            continue
        m = _ELSE.match(text, pos)
        if m is not None and (not m["colon"] or choice):
            # A bare word that something else can stand in for is a name.
            pos = m.end()
            continue
        literals += [word] if word else []
        p = _PLUS.match(text, pos) or (_BESIDE.match(text, pos) if bracket and found.get("q") else None)
        if p is None:
            break
        pos = p.end()
    return pos, literals


def _block(text: str, pos: int, at: int) -> tuple[int, list[tuple[int, int, str]]]:
    """The lines of a block that are indented deeper than the line of pos; at is the end of that line."""
    first = text.rfind("\n", 0, pos) + 1
    depth = lambda a, b: b - a - len(text[a:b].lstrip(" \t"))
    own, literals = depth(first, at), []
    while at < len(text):
        end = text.find("\n", at + 1)
        end = len(text) if end < 0 else end
        m = _LINES.search(text, at + 1, end)
        if m is not None:
            if depth(at + 1, end) <= own:
                break
            literals.append((m.start(), m.end(), m[0]))
        at = end
    return at, literals


def lex(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals that reach a sensitive name, in order, each literal once."""
    env: dict[str, Flow] = {}
    alone: list[tuple[float, int, str, Flow]] = []  # by how sensitive the name is
    joined: list[tuple[float, int, str, Flow]] = []  # by that and the joined value

    def flows(name: str, flow: Flow) -> None:
        if s := name_score(name):
            alone.append((s, len(alone), name, flow))
            if len(flow.parts) > 1 or any(isinstance(p, Flow) for p in flow.parts):
                joined.append((s * flow.whole(), alone[-1][1], name, flow))

    more = sorted((m.start(), k, m) for k, rule in enumerate((_SETTER, _PUT, _DEFINE, _FLAG, _ELEMENT)) for m in rule.finditer(text))
    more.reverse()

    def before(pos: int) -> None:
        """Take the pairs without a sign of assignment that begin before pos."""
        while more and more[-1][0] < pos:
            _, k, m = more.pop()
            if k == 4:
                flows(m[1], Flow([(m.start(2), m.end(2), m[2])]))
                continue
            # What stands behind the next such pair is that one's.
            end = more[-1][0] if more else len(text)
            literals = _items(text, m.end(), env, end) if k < 2 else _value(text, m.end(), env, end)[1]
            if literals:
                if k == 2:
                    env[m["name"]] = Flow(literals)
                flows(m["name"], Flow(literals))

    at = 0
    while (op := _OP.search(text, at)) is not None:
        start = text.rfind("\n", 0, op.start()) + 1
        stop = text.find("\n", op.end())
        stop = len(text) if stop < 0 else stop
        for m in _XML.finditer(text, max(at, start), stop):
            flows(m[1], Flow([(m.start(2), m.end(2), m[2])]))
        pos = max(at, start)
        while (m := _PAIR.search(text, pos, stop)) is not None:
            before(m.start())
            name, was = m[1] or m[2] or m[3], max(pos, start)
            pos, literals = _value(text, m.end(), env, len(text))
            if literals is None:
                continue
            names = [name]
            if m[3] and text[max(was, m.start() - 2) : m.start()].rstrip()[-1:] == "," and (t := _TARGETS.search(text[was : m.start()])) is not None:
                names = [n.strip(" \t$@") for n in t[1].split(",")[:-1]] + [name]
            for k, n in enumerate(names):
                if k:
                    c = _COMMA.match(text, pos)
                    pos, literals = _value(text, c.end(), env, len(text)) if c else (pos, None)
                    if literals is None:
                        break
                env[n] = Flow(literals)
                flows(n, env[n])
        at = stop
    before(len(text))
    single, whole, out = _reach(alone), _reach(joined), []
    for span, (s, order, name, value) in sorted(single.items()):
        best = (s * literal_score(value), -order, name)
        if span in whole and len(value) >= 4:
            best = max(best, (whole[span][0], -whole[span][1], whole[span][2]))
        if best[0] >= threshold and best[0] > 0:
            out.append((*span, best[2], best[0]))
    return out


def scan(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, str, float]]:
    """All spans of a text: (kind, start, end, name, score), by start, then kind as listed; code points, end exclusive."""
    out = []
    if _SIGNS.search(text):
        out = [("assign", m.start(), m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        starts, ends = [x[1] for x in out], [x[2] for x in out]  # in order, without overlaps
        free = lambda s, e: not (k := bisect_left(starts, e)) or ends[k - 1] <= s
        out += [("literal", s, e, name, score) for s, e, name, score in lex(text, threshold) if free(s, e)]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), "", 1.0) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), "", 1.0) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]
)


def find_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the array of secret spans of each whole text.

    A null or empty text has no spans; repeated rows stay; an empty table stays empty; an existing column named as
    the new one is replaced. The constants of a text are followed inside that text only.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
    keys = ("kind", "start", "end", "name", "score")

    def make():
        claim("secrets", lambda: None)
        return lambda texts: [pa.array([[dict(zip(keys, s, strict=True)) for s in scan(t, threshold)] for t in texts], kind)]

    return append_columns(docs, text_col, [T.StructField(spans_col, T.ArrayType(SPAN))], make)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every document."""
    found = find_secrets(read_documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"] != "literal")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        count("literal"),
    )
