"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs their votes.

Base spans follow four fixed patterns and always stay. Looser patterns propose more candidates: what
a base pattern drops because digits of a neighbour run into it, national phone numbers, spelled-out
email addresses, and secrets (keys, tokens, passwords). Labelers - a checksum, range or entropy, a
gazetteer, context words, the characters around and the shape - vote for, against or abstain; none
knows whether a span is a base one. The vote patterns of all candidates in all documents are counted
in Spark; on that small table EM estimates each labeler's reliability without any labels.

The posteriors are the targets of the final classifier, a logistic regression on hashed features of
the span itself and what stands around it: token shape, digits, separators, neighbouring characters
and words, besides the votes. It is fitted on at most MAX_TRAIN distinct candidates of each kind, the
first by a hash. A candidate it accepts is added where it overlaps no base span.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.storage import discard, durable

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
VOTERS = ("check", "gazetteer", "context", "border", "shape")
LOOK_BACK = 40  # characters before a span that hold its context words
MAX_TRAIN = 4_000
DIMENSIONS = 1 << 14

# The base patterns. Runs of digits are entered at their first digit only, where the
# leftmost match starts anyway.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile("[0-9]")

LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\[dot\]|\(dot\)| dot ) ?)[A-Za-z0-9-]{1,63})+")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
LOOSE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,128}(?![A-Za-z0-9_+/-])")
HEX = re.compile("[0-9a-f]+|[0-9A-F]+")
OBFUSCATED = ("[at]", "(at)", "[dot]", "(dot)", " dot ")
# Generic top-level names; every name of two letters is a country's.
TOP_LEVEL = frozenset("""
    com net org edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev page blog cloud online site website store shop tech
    space xyz club live life world today news media email agency company group team work digital network systems solutions services support software studio
    academy school university health care clinic bank finance money legal law consulting engineering global international design art music video photo game games
""".split())  # fmt: skip
# Leading digits of card issuers.
ISSUERS = ("4", "34", "37", "36", "38", *map(str, range(300, 306)), *map(str, range(51, 56)), *map(str, range(2221, 2721)), "6011", *map(str, range(644, 650)), "65", *map(str, range(3528, 3590)), "62", "50", "56", "57", "58", "6304", "6759")
# Country calling codes of one and two digits, and the zones whose codes have three.
CALLING = ("1", "7", "20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98")
CALLING_ZONES = ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")
# Prefixes that issuers give their keys.
KEY_PREFIXES = (
    "AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_", "pk_test_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "xoxs-",
    "eyJ", "ya29", "npm_", "pypi-", "hf_", "dop_v1_", "shpat_", "shpss_", "whsec_", "dckr_pat_",
)
DIGESTS = (32, 40, 56, 64, 96, 128)  # hexadecimal digits of common checksums
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "@"),
    "ip": ("ip", "addr", "host", "server", "login", "from"),
    "card": ("card", "visa", "pay", "credit", "tarjeta", "carte", "karte"),
    "phone": ("tel", "phone", "call", "fax", "mobil"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "auth", "bearer", "credential"),
}
AGAINST = (
    "version", "isbn", "order", "sha", "md5", "commit", "checksum", "uuid", "id=", "release", "http", "src=", "invoice", "serial", "part", "item", "sku", "model", "ticket", "case", "ref", "revision",
    "rev ", "digest", "hash", "build", "tracking", "batch", "lot ", "number", "no.", "nr.", "merge", "blob", "tree", "parent",
)
# Words directly before a span that say what it is a number of, whatever it looks like.
NAMED = re.compile(r"(?:^|[^a-z])(?:order|invoice|part|item|sku|model|ticket|case|ref|reference|revision|rev|commit|sha|sha1|sha256|md5|checksum|digest|hash|build|tracking|batch|lot|serial|isbn|issn|version|release|merge|blob|tree|parent)(?: +(?:no|nr|number|id|code))?[.:#]* *[\"'(]?$")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    base: bool


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def in_range(quad: str) -> bool:
    """No part above 255, whatever its leading zeros."""
    parts = [p.lstrip("0") or "0" for p in quad.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by start and then kind; leftmost, non-overlapping per kind."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(Span("email", start, end, True))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if in_range(m.group()):
                found.append(Span("ip", *m.span(), True))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                number = digits(m.group())
                if 12 <= len(number) <= 19 and luhn(number):
                    found.append(Span("card", *m.span(), True))
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m.group())) <= 15:
                found.append(Span("phone", *m.span(), True))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """More candidates, none overlapping a base span or one another."""
    found = []
    if any(x in text for x in OBFUSCATED):
        found += [Span("email", *m.span(), False) for m in LOOSE_EMAIL.finditer(text) if any(x in m.group() for x in OBFUSCATED)]
    if DIGIT.search(text):
        for kind, loose in (("phone", LOOSE_PHONE), ("card", LOOSE_CARD), ("ip", IP)):
            found += [Span(kind, *m.span(), False) for m in loose.finditer(text)]
        for m in SECRET.finditer(text):
            if DIGIT.search(m.group()) and not m.group().isdigit() and any(c.isalpha() for c in m.group()):
                found.append(Span("secret", *m.span(), False))
    out: list[Span] = []
    taken = iter([*base, Span("email", len(text) + 1, len(text) + 1, True)])
    held, last = next(taken), -1
    for s in ordered(found):
        while held.end <= s.start and held.start <= len(text):
            held = next(taken)
        if held.start >= s.end and s.start >= last:
            out.append(s)
            last = s.end
    return out


def entropy(text: str) -> float:
    """Bits a character, by the frequencies in the text itself."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def dialled(span: str, number: str) -> int:
    """Whether a number can be dialled: a calling code after a plus, or an area and an exchange that exist where it has ten digits."""
    if span.startswith("+"):
        return 1 if number.startswith(CALLING) or number.startswith(CALLING_ZONES) else -1
    if len(number) == 10:
        return 1 if number[0] in "23456789" and number[3] in "23456789" and number[1:3] != "11" and number[4:6] != "11" else -1
    return 0


def votes(text: str, s: Span) -> tuple[int, ...]:
    """Each labeler's vote for a candidate: 1 personal data, -1 not, 0 no opinion."""
    span, number = text[s.start : s.end], digits(text[s.start : s.end])
    before = text[max(0, s.start - LOOK_BACK) : s.start].lower()
    last, after = text[s.start - 1 : s.start] if s.start else "", text[s.end : s.end + 1]
    border = -1 if last.isalnum() or after.isalnum() else 1
    if s.kind == "card":
        check = 1 if luhn(number) else -1
        known = 1 if number.startswith(ISSUERS) else -1
        shape = 1 if len(number) in (15, 16) else -1
    elif s.kind == "ip":
        check = 1 if in_range(span) else -1
        known = -1 if span.startswith("0") else 1 if span.find(".") > 1 else 0
        shape = 1 if len(number) >= 8 else 0 if len(number) > 5 else -1
        border = -1 if border < 0 or last in (".", "v", "V", "-") or (after == "." and text[s.end + 1 : s.end + 2].isdigit()) else 1
    elif s.kind == "phone":
        check = 1 if 9 <= len(number) <= 15 else -1
        known = dialled(span, number)
        shape = 1 if any(c in span for c in "() ") else 0
        border = -1 if border < 0 or last in "#-./" and last else 1
    elif s.kind == "email":
        check = 1 if "@" in span or any(x in span for x in OBFUSCATED[:4]) else 0
        top = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        known = 1 if top in TOP_LEVEL or (len(top) == 2 and top.isalpha()) else -1
        shape = 1 if len(span) <= 80 else -1
    else:
        digest = bool(HEX.fullmatch(span)) and len(span) in DIGESTS
        # Words and numbers joined by signs are a name or a path, whatever the entropy of their letters.
        named = all(p.isdigit() or p.islower() and p.isalpha() for p in re.split("[-_+/]+", span) if p)
        check = -1 if entropy(span) < 3 or named else 0 if digest else 1
        known = 1 if span.startswith(KEY_PREFIXES) else -1 if digest or named else 0
        mixed = span.replace("_", "").replace("-", "").isalnum() and (span.upper() == span or (span.lower() != span and len(number) >= 3))
        border = -1 if last in "/.-" and last else 1 if last in "=:\"'" and last else -1 if digest else 0
        # A checksum that nothing is set to is a checksum.
        shape = min(border, 0) if digest else 1 if mixed or (HEX.fullmatch(span) and len(span) >= 16) else -1
    if NAMED.search(before):
        # A named number: no labeler that looks at the digits has a say against its name.
        return min(check, 0), min(known, 0), -1, -1, -1
    words = CONTEXT[s.kind]
    context = 1 if any(w in before for w in words) else -1 if any(w in before for w in AGAINST) else 0
    return check, known, context, border, shape


def pattern(text: str, s: Span) -> tuple[int, ...]:
    """What expectation-maximisation sees: the kind and the votes."""
    return KINDS.index(s.kind), *votes(text, s)


def token_shape(text: str) -> str:
    """Digits as 9, letters as a or A, runs with their length up to 4, other characters as they are."""
    out: list[str] = []
    run = 0
    for c in text:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        run = run + 1 if out and out[-1] == k else 1
        if run <= 4:
            out.append(k)
    return "".join(out)


def features(text: str, s: Span) -> list[int]:
    """Hashed features of a candidate: its shape and digits, what stands around it, and the votes."""
    span = text[s.start : s.end]
    number = digits(span)
    before, after = text[max(0, s.start - LOOK_BACK) : s.start], text[s.end : s.end + LOOK_BACK]
    previous, following = before.lower().split(), after.lower().split()
    own = [
        "bias", f"shape {token_shape(span)}", f"digits {len(number)}", f"length {min(len(span) // 4, 16)}", f"first {number[:1]}", f"two {number[:2]}",
        f"separators {''.join(sorted({c for c in span if not c.isalnum()}))}", f"last {token_shape(before[-1:])}", f"next {token_shape(after[:1])}",
        f"word {token_shape(previous[-1]) if previous and DIGIT.search(previous[-1]) else previous[-1] if previous else ''}",
        f"word2 {previous[-2] if len(previous) > 1 else ''}", f"after {token_shape(following[0]) if following else ''}",
    ]
    own += [f"{name} {vote}" for name, vote in zip(VOTERS, votes(text, s), strict=True)]
    return [zlib.crc32(f"{s.kind} {f}".encode()) % DIMENSIONS for f in own]


def candidates(docs: DataFrame) -> DataFrame:
    """Distinct candidates of all documents, base ones too: (kind, votes, features, h, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    base = base_spans(text)
                    found.update((pattern(text, s), tuple(features(text, s))) for s in (*base, *loose_spans(text, base)))
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p, _ in keys], pa.int32()),
                    pa.array([list(p[1:]) for p, _ in keys], pa.list_(pa.int32())),
                    pa.array([list(f) for _, f in keys], pa.list_(pa.int32())),
                    pa.array(found.values(), pa.int64()),
                ],
                names=["kind", "votes", "features", "n"],
            )

    rows = docs.select("text").mapInArrow(run, "kind int, votes array<int>, features array<int>, n long")
    return rows.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).withColumn("h", F.xxhash64("kind", "votes", "features"))


def reliabilities(counts: Counter, kind: int, rounds: int = 60) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """EM for one kind: (posterior by pattern, P(vote | class) as class x voter x vote, prior)."""
    own = sorted(p for p in counts if p[0] == kind)
    if not own:
        return {}, np.full((2, len(VOTERS), 3), 1 / 3), 0.5
    vote = np.array([p[1:] for p in own]) + 1
    weight = np.array([counts[p] for p in own], dtype=float)
    posterior = 1 / (1 + np.exp(-(vote - 1).sum(axis=1).astype(float)))
    one_hot = np.eye(3)[vote]
    # A few votes in favour of each labeler keep the classes in place; the first is "personal data".
    trust = np.array([[1.0, 2.0, 4.0], [4.0, 2.0, 1.0]])[:, None]
    for _ in range(rounds):
        both = np.stack([weight * posterior, weight * (1 - posterior)])
        table = np.einsum("cp,pvk->cvk", both, one_hot) + trust
        table /= table.sum(axis=2, keepdims=True)
        prior = (both[0].sum() + 1) / (both.sum() + 2)
        log = np.einsum("pvk,cvk->cp", one_hot, np.log(table)) + np.log([[prior], [1 - prior]])
        posterior = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
    return dict(zip(own, posterior.tolist(), strict=True)), table, prior


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, step: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on rows of hashed features, by gradient steps scaled by their history."""
    beta, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    weight = weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(beta[x].sum(axis=1), -30, 30)))
        gradient = np.bincount(x.ravel(), weights=np.repeat(weight * (p - y), x.shape[1]), minlength=DIMENSIONS) + ridge * beta / len(y)
        seen += gradient**2
        beta -= step * gradient / np.sqrt(seen)
    return beta.astype(np.float32)


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """The span classifier's weights, from the votes on all documents' candidates and no labels."""
    found = durable(candidates(docs), "candidates")
    patterns = found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()  # at most 3 ** 5 a kind
    counts = Counter({(r.kind, *r.votes): r.n for r in patterns})
    x, y, weight = [], [], []
    for kind in range(len(KINDS)):
        posterior = reliabilities(counts, kind)[0]
        for r in found.filter(F.col("kind") == kind).orderBy("h").limit(max_train).collect():
            x.append(r.features)
            y.append(posterior[(kind, *r.votes)])
            weight.append(math.log1p(r.n))  # so that a passage of many copies doesn't drown the rest
    discard(found)
    return fit(np.array(x), np.array(y), np.array(weight)) if x else np.zeros(DIMENSIONS, np.float32)


def chance(text: str, s: Span, weights: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[features(text, s)].sum())))))


def find_spans(text: str, weights: np.ndarray, threshold: float) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each by start and kind."""
    base = base_spans(text)
    added = [s for s in loose_spans(text, base) if chance(text, s, weights) >= threshold]
    return base, ordered([*base, *added])


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind's mark."""
    out, at, end = [], 0, -1
    for s in spans:
        if s.start >= end:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        end = at = max(end, s.end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """Personal data of each row: counts and digest of the base spans, all spans, and their number.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows with a null or
    repeated doc_id are judged each; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    weights = train(docs, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = find_spans(text.as_py() or "", weights, threshold)
                count = Counter(s.kind for s in base)
                rows.append((*(count[k] for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"],
            )

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask(docs: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The same rows and columns with personal data in ``text`` replaced; null texts stay null."""
    weights = train(docs, max_train)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked(t, find_spans(t, weights, threshold)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), pa.array(texts, pa.string()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
