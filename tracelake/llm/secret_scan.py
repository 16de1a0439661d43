"""Secret scans: certain spans by pattern, weak candidates only where complementary parts stand in their scope.

A credential comes in parts: an access identifier, a secret and an endpoint. Certain spans (base)
are reported alone. Weak candidates (a bare high-entropy run, an endpoint, an identifier
assignment) are linked by an interval join inside each scope, a paragraph: one is reported when its
scope holds a part of a complementary kind; with a `reach`, when its span, widened by that, meets one.
A candidate within another one is no part of its own (a link's path is no secret), and candidates that
overlap do not complement one another; a certain span does, also within an endpoint, as in a link with a token.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_texts, slices, small_batches, tidied

#: Base patterns; ASCII letters only fold in the keyword.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 32 or more are the maximal runs of [0-9a-f]+ that pass.
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Weak parts: a secret-like run, an endpoint, an identifier that is assigned.
RUN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh)://[^\s\"'<>()]{4,}|(?<![\w.])[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.amazonaws\.com(?![\w])")
USER = re.compile(r"""(?<![A-Za-z])(?i:user(?:_?name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""", re.ASCII)
SCOPE = re.compile(r"\n[\t\r ]*\n")

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "run", "endpoint", "user")
#: The role of each kind's spans in a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "run": "secret", "endpoint": "endpoint", "user": "id"}
#: A reach for callers that want near parts only; scan() and mask() take the whole scope unless told.
REACH = 256
#: Bits a character that a bare run needs at least.
ENTROPY = 3.5


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping spans of each base kind (start, end, kind)."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int | None = REACH) -> list[tuple[int, int, str]]:
    """Weak candidates that meet complementary parts in their scope, or within the reach if there is one."""
    weak = []
    if "://" in text or ".amazonaws." in text:
        weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    weak += [(m.start(), m.end(), "user") for m in USER.finditer(text)] if "=" in text or ":" in text else []
    if not base and not weak:
        return []
    taken = sorted((a, b) for a, b, _ in base)
    firsts = [a for a, _ in taken]
    furthest = list(accumulate((e for _, e in taken), max))

    def free(a: int, b: int, kind: str) -> bool:
        """Not over a certain span; an endpoint may hold some, but not lie in one."""
        k = bisect_left(firsts, a + 1 if kind == "endpoint" else b)
        return not k or furthest[k - 1] < (b if kind == "endpoint" else a + 1)

    weak += [(m.start(), m.end(), "run") for m in RUN.finditer(text) if _entropy(m[0]) >= ENTROPY and re.search(r"[0-9]", m[0]) and re.search(r"[A-Za-z]", m[0])]
    weak = _outermost([w for w in weak if free(*w)])
    if not weak:
        return []
    borders = [m.start() for m in SCOPE.finditer(text)]
    roles = ("secret", "id", "endpoint")
    certain = {r: sorted((a, b) for a, b, kind in base if ROLE[kind] == r) for r in roles}
    reached = {r: list(accumulate((b for _, b in spans), max)) for r, spans in certain.items()}
    begins = {r: sorted(a for a, _, kind in weak if ROLE[kind] == r) for r in roles}
    ends = {r: sorted(b for _, b, kind in weak if ROLE[kind] == r) for r in roles}

    def near(a: int, b: int, role: str) -> bool:
        """Whether a's scope, cut to [a - reach, b + reach) if there is a reach, has a part of the role: a certain span, or a candidate that ends before a or begins behind b."""
        k = bisect_left(borders, a)
        low, high = borders[k - 1] if k else 0, borders[k] if k < len(borders) else len(text)
        if reach is not None:
            low, high = max(a - reach, low), min(b + reach, high)
        spans = certain[role]
        at = bisect_left(spans, (high, 0))
        if at and reached[role][at - 1] > low:
            return True
        at = bisect_left(begins[role], b)
        if at < len(begins[role]) and begins[role][at] < high:
            return True
        at = bisect_right(ends[role], a)
        return bool(at and ends[role][at - 1] > low)

    others = {"secret": ("id",), "id": ("secret",), "endpoint": ("secret", "id")}
    # A secret needs an identifier, an identifier a secret; an endpoint needs both.
    return [w for w in weak if all(near(w[0], w[1], role) for role in others[ROLE[w[2]]])]


def _outermost(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that lie in no other, in their order; of equal ones the first."""
    kept, end = set(), -1
    for k in sorted(range(len(spans)), key=lambda k: (spans[k][0], -spans[k][1], k)):
        if spans[k][1] > end:
            kept.add(k)
            end = spans[k][1]
    return [s for k, s in enumerate(spans) if k in kept]


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int | None = None) -> DataFrame:
    """One row per row of docs with SCHEMA; spans lists kind:start:end in code points.

    A null or empty text has no spans; repeated rows get equal results; extra columns are left out; an
    empty table gives an empty one.
    """

    def work(ids: list, texts: list) -> dict:
        out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        out["doc_id"] = ids
        for t in texts:
            base = base_spans(t)
            more = linked_spans(t, base, reach)
            kinds = Counter(kind for _, _, kind in base)
            for name, value in (("n_assign", kinds["assign"]), ("n_access", kinds["access"]), ("n_hex", kinds["hex"]), ("n_linked", len(more)), ("base_sha256", hashlib.sha256(_listed(base).encode()).hexdigest()), ("spans", _listed(base + more))):
                out[name].append(value)
        return out

    return map_texts(docs, work, SCHEMA, doc_id, text)


def masked(text: str, reach: int | None = None) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    base = base_spans(text)
    spans = sorted(base + linked_spans(text, base, reach), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    if not spans:
        return text
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", reach: int | None = None) -> DataFrame:
    """The rows of docs, all columns, with the text masked; a null text stays null. n_chars, if it is a column, gets the new length where the text is not null. Repeated rows get equal texts; an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = [t if t is None else masked(t, reach) for t in part.column(at).to_pylist()]
                yield part.set_column(at, text, pa.array(made, part.schema.field(at).type))

    out = docs.mapInArrow(tidied(run), docs.schema)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text).cast(docs.schema[n_chars].dataType)))
    return out
