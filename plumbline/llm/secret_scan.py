"""Multipart credential linking.

A text is scanned for parts: access identifiers, secrets and endpoints. Some
patterns prove themselves (``strong``: provider formats, private keys, a quoted
value of high entropy under a secret's name); others are weak. Within a scope
(the lines between two blank ones) parts whose intervals, widened by ``reach``
characters, meet are joined. A strong secret or identifier is reported by itself,
with its partners; a weak secret only with an identifier or an endpoint, and a
weak identifier or endpoint only as such a partner.

A scope lies within one text, so the join is a sweep over a document's sorted
parts, in the task that read it: nothing is shuffled, and a hot source or a very
long text costs its length alone.

Defined cases: a null or empty text has no finding; a null id is kept as null;
equal rows give equal findings each; partners are all listed, in order;
a value of any length is taken whole, a private key without an END line with the
base64 lines that follow; overlapping matches of one kind count once (the strong
one, else the longer); an empty table gives no rows; extra columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean

REACH = 300
MASK = "[REDACTED]"
_NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|(?:client|app|access|auth)[_-]?(?:secret|token)|secret[_-]?(?:access[_-]?)?key|private[_-]?key|bearer)"
_ID_NAMES = r"(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|app[_-]?id|account(?:[_-]?(?:id|name))?|user(?:[_-]?name)?|login|tenant[_-]?id)"
_LABELLED = re.compile(r"(?i)(?<![A-Za-z0-9])(" + _NAMES + r")[\"']?[ \t]{0,4}(?:=>|:=|=|:)[ \t]{0,4}([\"']?)([^\s\"'<>{}\[\]]{6,})")
_ID_LABELLED = re.compile(r"(?i)(?<![A-Za-z0-9])(" + _ID_NAMES + r")[\"']?[ \t]{0,4}(?:=>|:=|=|:)[ \t]{0,4}[\"']?([\w.@+-]{3,})")
_BREAK = r"(?:[ \t]*+(?:\r?\n|\\r\\n|\\n)[ \t]*+)"
_LINE_END = r"(?=[ \t]*(?:[\r\n\\\"'<]|$))"
_FORMATS = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abeprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
    # a private key to its END line; without one, over the lines of its header and base64 that follow
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:" + _BREAK + r"++(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:" + _BREAK + r"++(?:[A-Za-z0-9+/]{40,}+={0,2}|[A-Za-z0-9+/]{16,}+={0,2}" + _LINE_END + r"))+(?:" + _BREAK + r"[A-Za-z0-9+/]++={0,2}" + _LINE_END + r")?)?"
)
_ACCESS = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}(?![A-Z0-9])")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Fa-f0-9]{32,}+|[A-Za-z0-9+/_-]{40,}+={0,2})(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,15}://[^\s\"'<>]{3,}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\d.])|(?<![A-Za-z0-9.-])(?:[a-z0-9-]{1,63}\.)+(?:com|net|org|io|dev|internal|local|cloud)(?::\d{1,5})?(?![A-Za-z0-9-])")
_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_DIGIT = re.compile(r"[0-9]")
KINDS = ("access", "secret", "endpoint")


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def parts(text: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, kind, strong, rule) in order of start; of one kind none overlap."""
    found: list[tuple[int, int, str, bool, str]] = []
    digit = _DIGIT.search(text) is not None
    if "=" in text or ":" in text:
        for m in _LABELLED.finditer(text):
            a, b = m.span(3)
            value = m[3].rstrip(".,;)") if not m[2] else m[3]
            b = a + len(value)
            strong = len(value) >= 16 and entropy(value) >= 3.0 and _DIGIT.search(value) is not None
            if "://" not in value and len(value) >= 6:
                found.append((a, b, "secret", strong, "labelled"))
        for m in _ID_LABELLED.finditer(text):
            found.append((*m.span(2), "access", False, "labelled"))
    if "_" in text or "-" in text or "AIza" in text:
        found += [(*m.span(), "secret", True, "format") for m in _FORMATS.finditer(text)]
    if digit:
        found += [(*m.span(), "secret", False, "bare") for m in _BARE.finditer(text) if _DIGIT.search(m[0]) and entropy(m[0]) >= 3.0]
        found += [(*m.span(), "access", True, "format") for m in _ACCESS.finditer(text)]
    if any(k != "endpoint" for _, _, k, _, _ in found):  # an endpoint alone is never reported
        found += [(*m.span(), "endpoint", False, "address") for m in _ENDPOINT.finditer(text)]
    found.sort(key=lambda x: (not x[3], x[0] - x[1], x[0]))
    taken: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}  # in order, disjoint
    out = []
    for x in found:
        spans = taken[x[2]]
        at = bisect_left(spans, x[:2])
        if (at == 0 or spans[at - 1][1] <= x[0]) and (at == len(spans) or x[1] <= spans[at][0]):
            spans.insert(at, x[:2])
            out.append(x)
    return sorted(out)


def link(text: str | None, reach: int = REACH) -> list[dict]:
    """Findings of one text: the interval join of its parts, swept in order within each scope."""
    if not text:
        return []
    found = parts(text)
    if not any(k != "endpoint" for _, _, k, _, _ in found):
        return []
    ends = [m.start() for m in _BLANK.finditer(text)] + [len(text)]
    scope, at = [], 0
    for p in found:
        while p[0] >= ends[at] and at < len(ends) - 1:
            at += 1
        scope.append(at)
    n = len(found)
    near: list[list[int]] = [[] for _ in found]
    active: list[int] = []
    for i in range(n):
        active = [j for j in active if scope[j] == scope[i] and found[j][1] + reach >= found[i][0]]
        for j in active:
            if found[i][2] != found[j][2]:
                near[i].append(j)
                near[j].append(i)
        active.append(i)
    out = []
    used = set()
    for i, (a, b, kind, strong, rule) in enumerate(found):
        partners = sorted(near[i])
        if kind == "secret" and (strong or partners):
            used.update(partners)
            out.append((i, partners))
    for i, (_, _, kind, strong, _) in enumerate(found):
        if kind == "access" and strong and i not in used:
            out.append((i, [j for j in sorted(near[i]) if found[j][2] == "endpoint"]))
    rows = []
    for i, partners in sorted(out):
        a, b, kind, strong, rule = found[i]
        spans = {k: [{"start": found[j][0], "end": found[j][1]} for j in partners if found[j][2] == k] for k in KINDS}
        rows.append({"scope": scope[i], "kind": kind, "rule": rule, "strong": strong, "start": a, "end": b, "access": spans["access"], "endpoints": spans["endpoint"], "digest": hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest()[:16]})
    return rows


_SPAN = "array<struct<start:int,end:int>>"
SCHEMA = f"doc_id long, scope int, kind string, rule string, strong boolean, start int, end int, access {_SPAN}, endpoints {_SPAN}, digest string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("scope", pa.int32()), ("kind", pa.string()), ("rule", pa.string()), ("strong", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("access", _SPANS), ("endpoints", _SPANS), ("digest", pa.string())])


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row a finding; ``digest`` stands for the value, which isn't shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    rows += [{"doc_id": i} | r for r in link(text, reach)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA)


def mask(text: str | None, reach: int = REACH) -> str | None:
    """The text with reported secrets and their identifiers masked."""
    rows = link(text, reach)
    if not rows:
        return text
    spans = sorted({(r["start"], r["end"]) for r in rows} | {(s["start"], s["end"]) for r in rows for s in r["access"]})
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """All rows and columns, ``text`` masked and ``n_chars``, where there is one, of the masked text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                text = pa.array([mask(x, reach) for x in part.column(at).to_pylist()], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([text if k == at else part.column(k) for k in range(len(names))], names=names)

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
