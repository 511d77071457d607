"""Personal data by weak supervision.

Base spans are exact patterns.  Wider patterns propose further candidate spans (masked or spaced addresses, numbers
in other groupings, numbers that fail a check).  Four labelers vote on every candidate: a validator, a gazetteer, the
context and the shape.  The votes are counted by pattern over all documents; expectation-maximisation on these counts
estimates how reliable each labeler is and how likely a pattern is personal; a logistic span classifier is trained on
the estimates, with features of the surroundings beside the votes.  Candidates that it accepts and that overlap no
base span are added.  The number of patterns is bounded by the vote alphabet, so the driver holds a fixed-size table.

Defined results: a null or empty text has no spans; repeated rows are treated alike; offsets are code points, end
exclusive; a table without candidates trains nothing and adds nothing; an empty table gives no rows; other columns
are not read (redact() keeps them as they are).
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.llm.common import materialize, table, tidy

KINDS = ("email", "ip", "card", "phone")
#: Probability from which a candidate is added.
ACCEPT = 0.5
#: Top-level domains of the gazetteer, and country codes; it has no opinion on those that are common words.
TLDS = frozenset("com org net edu gov mil int info biz name io ai app dev cloud online site shop test example invalid local".split())
COUNTRIES = frozenset(
    "ac ad ae af ag ai al ao aq ar au aw ax az ba bb bd bf bg bh bi bj bm bn bo br bs bt bw bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "dj dk dm dz ec ee eg er et eu fi fj fk fm fo ga gb gd gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu ie il im io iq ir jm jo jp "
    "ke kg kh ki km kn kp kr kw ky kz lb lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx mz na nc ne nf ng ni nl np nr "
    "nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa ro rs ru rw sa sb sc sg sh si sk sl sm sn sr ss st sv sx sy sz tc td tf tg th tj tk tl tm tn tr "
    "tt tv tw tz ua ug uk uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw de fr es".split()
)
CUES = (
    ("mail", "contact", "write", "address", "correo", "adresse", "kontakt"),
    ("ip", "host", "server", "address", "addr", "login", "dns"),
    ("card", "visa", "master", "amex", "credit", "tarjeta", "carte", "karte", "cc", "payment"),
    ("phone", "tel", "call", "fax", "mobile", "cell", "dial", "sms", "whatsapp", "telefon", "teléfono", "téléphone"),
)
AGAINST = ("version", "isbn", "issn", "order", "invoice", "serial", "build", "release", "sku", "token", "hash", "page")
REACH = 32

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|<at>) ?| at | ?@ ?", re.I)
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>) ?| dot |\.)[A-Za-z0-9-]{1,63})+", re.I)
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>) ?| dot |\.", re.I)
_IP_MASKED = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )[0-9]{1,3}){3}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_CARD_WIDE = re.compile(r"(?<![0-9.])[0-9]{4}(?:[./_\t ]| {2}| - )[0-9]{4,6}(?:[./_\t ]| {2}| - )[0-9]{4,5}(?:(?:[./_\t ]| {2}| - )[0-9]{1,4})?(?![0-9])")
_PHONE_WIDE = re.compile(r"(?<![0-9+A-Za-z(-])(?:(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|00[0-9]{9,13})(?![0-9A-Za-z])")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(spans as (kind, start, end) that hold, matches of the patterns that fail their check)."""
    good: list[tuple[int, int, int]] = []
    bad: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            good.append((0, start, done := m.end()))
            end = done
        else:
            done = at + 1
        at = text.find("@", end)
    if not _DIGIT.search(text):
        return good, bad
    for m in _IP.finditer(text):
        (good if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")) else bad).append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19:
                (good if luhn(d) else bad).append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 9 <= len(_digits(m.group())) <= 15 else bad).append((3, *m.span()))
    return good, bad


def wide_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates of the wider patterns."""
    found = []
    low = text.lower()
    if "@" in low or " at " in low or "at)" in low or "at]" in low or "at}" in low or "at>" in low:
        for m in _AT.finditer(text):
            if after := _AFTER_AT.match(text, m.end()):
                if before := _BEFORE_AT.search(text, max(0, m.start() - 64), m.start()):
                    found.append((0, before.start(), after.end()))
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP_MASKED), (2, _CARD_WIDE), (3, _PHONE_WIDE)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
        if text.count(":") >= 7:
            found += [(1, *m.span()) for m in _IP6.finditer(text)]
    return found


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, int, int, int]:
    """Validator, gazetteer, context, shape: 1 for, -1 against, 0 no opinion."""
    s = text[start:end]
    d = _digits(s)
    near = text[max(0, start - REACH) : start].lower()
    if kind == 0:
        parts = _DOT.split(_AT.split(s, maxsplit=1)[-1].split("@")[-1])
        checked = 1 if len(parts) >= 2 and all(p and p[0] != "-" and p[-1] != "-" for p in parts) else -1
        last = parts[-1].lower()
        listed = 1 if last in TLDS or last in COUNTRIES else 0 if len(last) == 2 and last.isalpha() else -1
        shape = 1 if re.search(r"[(\[{<](?:at|dot)[)\]}>]|@\w", s, re.I) else 0
    elif kind == 1:
        parts = re.findall(r"[0-9]+", s)
        six = ":" in s
        checked = 1 if six or len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        listed = 0 if six else 1 if parts[0] not in ("0", "255") and len(parts[0]) <= 3 else -1
        shape = -1 if text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit() or text[start - 1 : start] == "." and start else 1
    elif kind == 2:
        checked = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        listed = 1 if d[:1] in ("3", "4", "5", "6") and len(d) in (14, 15, 16) else -1 if d[:1] in ("0", "1", "7", "8", "9") else 0
        shape = 1 if re.fullmatch(r"(?:[0-9]{4}\D{1,3}){3}[0-9]{4}|[0-9]{16}|[0-9]{4}\D{1,3}[0-9]{6}\D{1,3}[0-9]{5}", s) else 0
    else:
        checked = 1 if 9 <= len(d) <= 15 else -1
        area = re.search(r"\(([0-9]{3})\)", s)
        own = area[1] if area else (d[1:4] if d[:1] == "1" and len(d) == 11 else d[:3])
        listed = 1 if own[:1] not in ("0", "1") or s.startswith("00") else 0
        shape = 1 if re.search(r"[0-9]{3}[ .-][0-9]{4}\Z", s) else 0
    words = re.findall(r"[^\W\d_]+", near)[-5:]
    context = 1 if any(w.startswith(c) for w in words for c in CUES[kind]) else -1 if any(w.startswith(c) for w in words for c in AGAINST) else 0
    return checked, listed, context, shape


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2


def pattern_of(text: str, kind: int, start: int, end: int) -> int:
    code = 0
    for v in votes(text, kind, start, end):
        code = code * 3 + v + 1
    left, right = _side(text[start - 1 : start] if start else ""), _side(text[end : end + 1])
    size = min(3, (end - start) // 8)
    return (((code * 3 + left) * 3 + right) * 4 + size) * 4 + kind


def unpack(pattern: int) -> tuple[int, list[int], int, int, int]:
    rest, kind = divmod(pattern, 4)
    rest, size = divmod(rest, 4)
    rest, right = divmod(rest, 3)
    code, left = divmod(rest, 3)
    return kind, [code // 27 % 3 - 1, code // 9 % 3 - 1, code // 3 % 3 - 1, code % 3 - 1], left, right, size


def fit_patterns(counts: dict[int, int], rounds: int = 40) -> dict[int, float]:
    """Probability that a candidate of each pattern is personal data."""
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], dtype=float)
    parts = [unpack(k) for k in keys]
    kind = np.array([p[0] for p in parts])
    v = np.array([p[1] for p in parts])
    q = np.where(v.sum(1) > 0, 0.9, 0.1)
    for _ in range(rounds):  # reliabilities from posteriors, posteriors from reliabilities
        prior = np.array([(q[kind == k] @ n[kind == k] + 1) / (n[kind == k].sum() + 2) for k in range(4)])[kind]
        yes, no = np.log(prior), np.log(1 - prior)
        for labeler in range(4):
            for vote in (-1, 0, 1):
                is_vote = v[:, labeler] == vote
                yes = yes + is_vote * np.log(((q * n)[is_vote].sum() + 1) / ((q * n).sum() + 3))
                no = no + is_vote * np.log((((1 - q) * n)[is_vote].sum() + 1) / (((1 - q) * n).sum() + 3))
        q = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    # the span classifier: logistic regression on votes, kind and surroundings, trained on the posteriors
    columns = [np.ones(len(keys))] + [(kind == k).astype(float) for k in range(4)]
    columns += [(v[:, j] == x).astype(float) for j in range(4) for x in (-1, 1)]
    columns += [np.array([p[i] == x for p in parts], dtype=float) for i, top in ((2, 3), (3, 3), (4, 4)) for x in range(1, top)]
    x = np.stack(columns, axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (n * (q - p)) - 0.1 * w)
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def apart(spans: Iterable[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap no base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts, ends = [s for s, _ in taken], list(itertools.accumulate((e for _, e in taken), max))
    # of the base spans that begin before a span's end none may end after its start
    return [c for c in spans if not (k := bisect.bisect_left(starts, c[2])) or ends[k - 1] <= c[1]]


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and every candidate with its pattern, base ones first.  Others that overlap a base span cannot be added
    and are no candidates: their votes would be evidence counted twice."""
    base, failed = base_spans(text)
    every = dict.fromkeys([*base, *apart([*failed, *wide_spans(text)], base)])
    return base, [(*c, pattern_of(text, *c)) for c in every]


def chosen(base: list[tuple[int, int, int]], found: list[tuple[int, int, int, int]], accepted: dict[int, float]) -> list[tuple[int, int, int]]:
    """Base spans and the accepted candidates that overlap nothing, likeliest first."""
    spans = list(base)
    for k, s, e, p in sorted(found, key=lambda c: (-accepted.get(c[3], 0.0), c)):
        if p in accepted and all(e <= a or b <= s for _, a, b in spans):
            spans.append((k, s, e))
    return spans


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            part = whole.slice(at, 512)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


#: Shapes of access keys, and names before a value that holds a digit.
SECRET = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|pwd|token|secret|api[_-]?key)[ ]?[=:][ ]?\"?(?=[^\s\"]*[0-9])[^\s\"]{8,}\"?", re.IGNORECASE)
_HINT = re.compile(r"AKIA|[=:]")


def secrets(text: str) -> list[tuple[int, int]]:
    """Spans of access keys and of assigned passwords and tokens.  They are no kind of the labelers: a fixed rule."""
    return [m.span() for m in SECRET.finditer(text)] if _HINT.search(text) else []


_FOUND = "array<struct<kind:int,start:int,end:int,pattern:int>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())])


def propose(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found, n_secrets): base spans (pattern -1) and candidates of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "pattern")
        for ids, texts in _texts(batches):
            both = [candidates(t) for t in texts]
            base = [[dict(zip(names, (*s, -1), strict=True)) for s in b] for b, _ in both]
            found = [[dict(zip(names, s, strict=True)) for s in f] for _, f in both]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_SPAN)), pa.array([len(secrets(t)) for t in texts], pa.int64())], ["doc_id", "base", "found", "n_secrets"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {_FOUND}, found {_FOUND}, n_secrets long")


def accepted_patterns(proposed: DataFrame, accept: float = ACCEPT) -> dict[int, float]:
    rows = proposed.select(F.explode("found.pattern").alias("p")).groupBy("p").count().collect()  # a bounded alphabet
    return {k: p for k, p in fit_patterns({r[0]: r[1] for r in rows}).items() if p >= accept}


def spans_of(proposed: DataFrame, accepted: dict[int, float]) -> DataFrame:
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secrets long, n_found long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda x: (x["kind"], x["start"], x["end"], x["pattern"])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                base = [plain(x)[:3] for x in r["base"]]
                spans = chosen(base, [plain(x) for x in r["found"]], accepted)
                rows.append((r["doc_id"], *(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), r["n_secrets"], len(spans) + r["n_secrets"]))
            columns = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return proposed.mapInArrow(run, schema)


@tidy
def find_pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    proposed = materialize(propose(docs))
    return spans_of(proposed, accepted_patterns(proposed, accept))


def redact(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """docs with every span of their text replaced by <KIND>, secrets by <SECRET>; a null text stays null, all columns
    stay."""
    accepted = accepted_patterns(propose(docs), accept)
    at, schema = docs.columns.index("text"), docs.schema

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        spans = [(s, e, KINDS[k].upper()) for k, s, e in chosen(*candidates(text), accepted)] + [(s, e, "SECRET") for s, e in secrets(text)]
        for s, e, kind in sorted(spans):
            if s >= end:
                out += [text[end:s], f"<{kind}>"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
