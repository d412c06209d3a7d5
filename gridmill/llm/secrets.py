"""Secret scans: base patterns and an assignment-aware lexer.

The lexer reads ``name = literal``, ``name: literal``, ``name := literal`` and ``name => literal`` in source and
configuration syntax, with quoted or bare literals and ``+`` between parts.  Names that hold a constant are
remembered, in order, so ``K = "..."`` followed by ``client_secret = K`` or ``"${K}"`` leads back to the literal.
A literal is scored by how sensitive the words of its target names are, and by its own length,
variety and placeholders; from ``SCORE`` on it is a span of kind ``lexed``.  Names, blanks, literals, parts and constants have
no bound; matching never goes back, and values are kept as places in the text.  A PEM block is read to its end line.

Defined cases: null counts as empty text, which has no spans.  An empty table gives an empty result.  Texts are scanned one by one and whole, so ties,
repeated rows and null ids need no care.  Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections import Counter
from itertools import accumulate
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, sliced, tidied

#: Fixed patterns of the base kinds, in the order of kinds.
_any_case = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive a word of a name is; two words of the second table count together.
WORDS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0, "bearer": 0.8, "pass": 0.8}
PARTS = {"key": 0.5, "auth": 0.5, "api": 0.4, "access": 0.4, "private": 0.5, "signing": 0.5, "encryption": 0.5, "client": 0.2, "master": 0.4, "session": 0.3, "db": 0.2, "admin": 0.2, "salt": 0.5}
PLACEHOLDERS = frozenset("none null true false undefined todo changeme change_me placeholder test dummy password secret token".split())
SCORE = 0.5

SEPARATOR = re.compile(r"(?::=|=>|=|:)(?![=/])")
NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-"
PART = re.compile(r"""[\x20\t]*+(?:"((?:\\.|[^"\\\n])*+)"|'((?:\\.|[^'\\\n])*+)'|`([^`\n]*+)`|([A-Za-z0-9_$+/=.~!@^-]++))""")
PLUS = re.compile(r"[\x20\t]*+\+(?=[\x20\t]*+[\"'`A-Za-z_$])")
REFERENCE = re.compile(r"(?:\$\{?|%|#\{)?([A-Za-z_][A-Za-z0-9_.]*+)[}%]?")
PEM = re.compile(r"""[\x20\t]*+(?:[|>][+-]?[\x20\t]*+\n)?\s*+["'`]*+\s*+(-----BEGIN ([A-Z0-9 ]*+)-----)""")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Words of messages rather than of passphrases.
COMMON = frozenset("a an and are as at be by can cannot do enter for from has have if in incorrect invalid is it may must no not of on or please should that the this to too was will with you your".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the secret itself) of the base kinds."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def name_score(name: str) -> float:
    """From 0 to 1: how sensitive what a name holds is."""
    words = [w.lower() for w in WORD.findall(name)]
    joined = [a + b for a, b in zip(words, words[1:])]
    best = max((WORDS.get(w, 0.0) for w in words + joined), default=0.0)
    return max(best, min(1.0, sum(PARTS.get(w, 0.0) for w in set(words))))


class Value:
    """What a part and the parts after it hold, as places in the text; what scoring needs is gathered when it is asked for."""

    __slots__ = ("span", "ref", "tail", "counts", "size", "common", "head", "end", "told")

    def __init__(self, span: tuple[int, int] | None, ref: Value | None, tail: Value | None):
        self.span, self.ref, self.tail, self.counts, self.told = span, ref, tail, None, False


def gathered(value: Value, text: str, last: list) -> Value:
    """``value`` with character counts, size, common words, first and last characters; ``last`` is the last span counted."""
    todo = [value]
    while todo:
        x = todo[-1]
        wait = [y for y in (x.ref, x.tail) if y is not None and y.counts is None]
        if x.counts is not None or wait:
            if x.counts is not None:
                todo.pop()
            todo += wait
            continue
        if x.ref:
            counts, x.size, x.common, x.head, x.end = x.ref.counts, x.ref.size, x.ref.common, x.ref.head, x.ref.end
        else:
            a, b = x.span
            if last and last[0] <= a < last[1] == b:  # a later start in the same run
                counts = Counter(last[2])
                counts.subtract(text[last[0] : a])
                counts = +counts
            else:
                counts = Counter(text[a:b])
            last[:] = a, b, counts
            x.size, x.head, x.end = b - a, text[a : min(b, a + 64)], text[max(a, b - 2) : b]
            x.common = sum(w.strip(".,;:!?").lower() in COMMON for w in text[a:b].split()) if counts[" "] else 0
        if y := x.tail:
            counts, x.size, x.common = counts + y.counts, x.size + y.size, x.common + y.common
            x.head, x.end = (x.head + y.head)[:64], (x.end + y.end)[-2:]
        x.counts = counts
        todo.pop()
    return value


def placeholder(x: Value) -> bool:
    low, word = x.head.lower(), lambda but="": all(c.isalnum() or c == "_" or c in but for c in x.counts)
    if {c.lower() for c in x.counts} in ({"x"}, {"*"}, {"."}, {"-"}) or x.size <= 64 and low in PLACEHOLDERS:
        return True
    if low.startswith("example") and word() or low.startswith(("your_", "your-")):
        return True
    if x.head[0] == "%" and x.end[-1] == "%" and x.counts["%"] == 2 and x.size > 2 and word("%"):
        return True
    return x.head[0] == "<" and x.end[-1] == ">" or low.startswith("${") and x.end[-1] == "}" or low.startswith("{{") and x.end == "}}"


def literal_score(x: Value) -> float:
    """From 0 to 1: how much a literal looks like a secret rather than a word, a flag, a message or a placeholder.

    A private key block counts fully.  More than two blanks make a passphrase, or a message if the
    literal ends like a sentence or if a quarter of its words are common ones.
    """
    n = x.size
    if n < 6 or placeholder(x):
        return 0.0
    if PRIVATE.match(x.head):
        return 1.0
    blanks = x.counts[" "]
    if blanks > 2 and (x.end[-1] in ".?!:" or 4 * x.common >= blanks + 1):
        return 0.0
    bits = -sum(k / n * log2(k / n) for k in x.counts.values())
    held = "".join(x.counts)
    kinds = sum(bool(re.search(p, held)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    return min(1.0, bits / 3.0) * (1.0 if kinds >= 2 or blanks > 2 else 0.7 if n >= 12 else 0.5)


def lexed_spans(text: str) -> list[tuple[int, str, int, int]]:
    """Literals that reach a sensitive name, directly or through constants."""
    constants: dict[str, Value] = {}
    chains: dict[int, Value] = {}  # by where a part starts: it and the parts after it, as first read
    ends: dict[str, int] = {}  # by label of a block: where it is next closed
    spans: set[tuple[int, int]] = set()
    last: list = []
    runs: list[tuple[int, int]] = []  # bare literals that were read, ascending
    before = 0

    def block(at: int) -> Value | None:
        m = PEM.match(text, at)
        if not m:
            return None
        close = f"-----END {m[2]}-----"
        if -1 < ends.get(close, 0) < m.end():
            ends[close] = text.find(close, m.end())
        return Value((m.start(1), ends[close] + len(close)), None, None) if ends[close] >= 0 else None

    def chain(at: int) -> Value | None:
        read = []
        tail = None
        while True:
            if at in chains:
                tail = chains[at]
                break
            k = bisect_right(runs, (at, len(text))) - 1
            if k >= 0 and at < runs[k][1]:  # within a bare literal that was read before
                a, b, bare = at, runs[k][1], True
            elif m := PART.match(text, at):
                (a, b), at_end, bare = m.span(m.lastindex), m.end(), m.lastindex == 4
                if bare:
                    insort(runs, (a, b))
            else:
                break
            ref = REFERENCE.fullmatch(text, a, b) if bare or text[a : a + 1] in ("$", "%", "#") else None
            held = constants.get(ref[1]) if ref else None
            read.append((at, None if held else (a, b), held))
            plus = PLUS.match(text, b if bare else at_end)
            if not plus:
                break
            at = plus.end()
        for at, span, held in reversed(read):
            tail = chains[at] = Value(span, held, tail)
        return tail

    for sep in SEPARATOR.finditer(text):
        left = text[before : sep.start()].rstrip(" \t")
        before = sep.end()
        if left[-1:] in ('"', "'", "]"):
            left = left[:-1]
        name = left[len(left.rstrip(NAME)) :].lstrip("0123456789.-")
        if not name:
            continue
        value = block(sep.end()) or chain(sep.end())
        if not value:
            continue
        constants[name] = constants[name.rpartition(".")[2]] = value
        if (s := name_score(name)) >= SCORE and s * literal_score(gathered(value, text, last)) >= SCORE:
            todo = [value]
            while todo:
                x = todo.pop()
                if x and not x.told:
                    x.told = True
                    todo += [x.ref, x.tail]
                    if x.span and x.span[1] > x.span[0]:
                        spans.add(x.span)
    return [(a, "lexed", b, a) for a, b in spans]


def all_spans(text: str) -> tuple[list, list]:
    """(base spans, all spans), in order of start, then kind; a lexed span inside a base one isn't repeated."""
    base = base_spans(text)
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))  # reach[k]: the furthest end of the first k + 1
    extra = []
    for x in lexed_spans(text):
        k = bisect_right(starts, x[0])
        if not k or reach[k - 1] < x[2]:
            extra.append(x)
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[1])))


def redacted(text: str, spans: list, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b in sorted((x[3], x[2]) for x in spans):
        if b <= at:
            continue
        out += [text[at : max(a, at)], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with one more column, the last: a struct of n_base spans by kind, spans and digests.

    With ``redact``, the text column comes back with every secret replaced.
    """
    out = fresh("secrets", docs)
    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        made_type = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
        for batch in sliced(batches):
            made, texts, changed = [], [], False
            for x in batch.column(at):
                raw = x.as_py()
                text = raw or ""
                base, spans = all_spans(text)
                told = lambda some: ",".join(f"{k}:{a}:{b}" for a, k, b, _ in some)
                count = lambda kind: sum(k == kind for _, k, _, _ in base)
                made.append({"n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base_sha256": hashlib.sha256(told(base).encode()).hexdigest(), "spans": told(spans), "found": [{"kind": k, "start": a, "end": b} for a, k, b, _ in spans]})
                if redact:
                    changed = changed or bool(spans)
                    texts.append(redacted(text, spans) if spans else raw)
            columns = [*batch.columns, pa.array(made, made_type)]
            if changed:
                columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    typed = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)]
    flat = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return flat.mapInArrow(tidied(run), ", ".join([*typed, f"c{len(typed)} struct<{fields.replace(' long', ':long').replace(' string', ':string').replace('found array', 'found:array')}>"])).toDF(*docs.columns, out)
