"""Personal data by candidate gradient boosting.

Generators propose overlapping spans with high recall: four base patterns (email, ip, card, phone), which are always kept, and loose
variants of the same kinds (addresses spelled with at and dot, telephone numbers without a plus, spaced or split card and network
numbers). Boosted regression trees score each loose span from its format and the words around it; spans whose calibrated probability
reaches their kind's threshold are added, best first, where they overlap no span that is kept already.

The trees are fitted on the driver, once, and broadcast. They learn from SENTENCES sentences composed by rule with a fixed seed: personal
data in many forms, and numbers that are none (dates, years, ranges, versions, order numbers, groups that fail the check digit). Half of
the sentences train the trees, a quarter calibrates the score (Platt), and a quarter sets the thresholds: for each kind the least
probability, from 0.5 up, from which on PRECISION is kept. No sentence is in two parts. What is measured in tests comes from
elsewhere: sentences written by hand, and the table of documents.

Defined results: null text is empty; positions are code points, ends exclusive; overlapping base spans of different kinds all stay; ties
in probability go to the earlier and shorter span; every row gives one row, repeated rows and doc_ids too; extra columns are ignored by
find_personal_data and carried, whatever their names, by redact_documents; an empty table gives no rows; texts are scanned whole, in
time linear in their length.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SENTENCES = 8000
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern: at each @ the whole run of local characters before it, so time stays linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1  # a local part never reaches back over an @
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- loose candidates
_WORD = r"[A-Za-z0-9._%+-]{1,64}"
_HOST = r"[A-Za-z0-9-]{1,63}"
_AT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
_LOOSE = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-]){_WORD}{_AT}{_HOST}(?:{_DOT}{_HOST})+", re.I)),
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-]){_WORD}\x20@\x20{_HOST}(?:\.{_HOST})+")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?\[?\.\]?\x20?[0-9]{1,3}){3}(?![0-9.])")),
    ("phone", re.compile(r"(?<![0-9+(.-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,8}\)?){1,5}(?![0-9.-])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{3,6}){2,4}(?![0-9])")),
)
#: What every candidate holds: two digits with a separator between, an at in brackets or blanks with a dot to follow, or a lone @.
_PREFILTER = re.compile(r"[0-9][\x20./_()\[\]-]{1,5}[0-9]|[\[({]\x20?at|\x20@\x20|\x20at\x20[a-z0-9-]{1,63}(?:\x20?[.\[({]|\x20dot)", re.I)
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address|send)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|addr(?:ess)?|from|login|ping|router)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|payment|pan|mastercard|paid)\b", re.I),
    "phone": re.compile(r"\b(?:tel|phone|call|mobile|cell|fax|dial|ring|text|number)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|release|section|chapter|page|pages|order|invoice|isbn|build|date|year|years|figure|table|step|score|ratio|id|row|rows|between|until|since|in|sum|total|measured)\b", re.I)
_YEAR = re.compile(r"(?<![0-9])(?:1[89]|20)[0-9]{2}(?![0-9])")
_ENDING = re.compile(r"(?<![A-Za-z])(?:com|org|net|edu|info|io|de|fr|es|uk|eu)\Z", re.I)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    near = before[before.rfind(". ") + 1 :]
    d, low = digits_of(span), span.lower()
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    return [
        float(KINDS.index(kind)), float(end - start), float(len(d)), float(len(groups)), float(max(groups)), float(min(groups)), float(luhn(d)) if d else 0.0,
        float(span.count(" ")), float(span.count("-")), float(span.count(".")), float(span.count("/")), float("(" in span), float("[" in span),
        float(max((int(g) for g in re.findall(r"[0-9]+", span)), default=0) <= 255), float(bool(_CUES[kind].search(near))), float(bool(_AGAINST.search(near[-14:]))),
        float(bool(_AGAINST.search(after))), float(len(_YEAR.findall(span))), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(d[:1] == "0"), float(bool(_ENDING.search(span))), float(" dot " in low or "[dot" in low or "(dot" in low or "{dot" in low), float(groups[-1]), float(groups[0]),
    ]


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, p in _LOOSE for m in p.finditer(text)] if _PREFILTER.search(text) else []


# ---------------------------------------------------------------- boosted trees
class Trees:
    """Logistic gradient boosting with exact splits on small data: depth-3 trees, Newton leaves."""

    def __init__(self, depth: int = 3, rounds: int = 40, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.least, self.ridge = depth, rounds, rate, least, ridge
        self.trees: list[tuple] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        score = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.start = float(score[0])
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self.rate * self._values(tree, x)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, None, None)
        for j in range(x.shape[1]) if depth and len(rows) > 1 else ():
            order = np.argsort(x[rows, j], kind="stable")
            v, cg, ch = x[rows[order], j], np.cumsum(g[rows[order]])[:-1], np.cumsum(h[rows[order]])[:-1]
            ok = (v[1:] > v[:-1]) & (ch >= self.least / 4) & (hs - ch >= self.least / 4)
            gain = np.where(ok, cg**2 / (ch + self.ridge) + (gs - cg) ** 2 / (hs - ch + self.ridge) - gs**2 / (hs + self.ridge), -1)
            if len(gain) and gain[i := int(np.argmax(gain))] > best[0]:
                best = (float(gain[i]), j, float(v[i] + v[i + 1]) / 2)
        if best[1] is None:
            return (float(gs / (hs + self.ridge)),)
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _values(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] <= tree[1], self._values(tree[2], x), self._values(tree[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._values(t, x) for t in self.trees), np.zeros(len(x)))


def labelled_sentences(n: int, seed: int = 7) -> list[list[tuple[str, str, int, int, int]]]:
    """For each of n composed sentences, its candidates (text, kind, start, end, label): personal data, and numbers that are none."""
    r, out = random.Random(seed), []
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = lambda k: r.choice("123456789") + num(k - 1)
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "le", "mi", "so", "ka", "ti", "ve", "bo", "ru")) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(r.choice((word(), word(), "the", "of", "and", "was", "in", "to")) for _ in range(k))
    year = lambda: str(r.randint(1850, 2060))
    end = lambda: r.choice(("com", "org", "net", "edu", "io", "de", "fr", "co.uk"))

    def card(valid: bool = True) -> str:
        body = r.choice("3456") + num(14)
        return body + next(c for c in r.sample("0123456789", 10) if luhn(body + c) == valid)

    def grouped(sizes, joint: str) -> str:
        return joint.join(some(k) for k in sizes)

    at, dot = lambda: r.choice((" [at] ", " (at) ", "(at)", "[at]", " at ", "{at}")), lambda: r.choice((" [dot] ", " (dot) ", "[dot]", ".", " dot "))
    local = lambda: r.choice((f"{word()}.{num(2)}", word(), f"{word()}_{word()}", f"{word()}{num(2)}", f"{word()}.{word()}"))
    spelled = lambda: (lambda a, d: f"{local()}{a}{word()}{' dot ' if a == ' at ' and d == '.' else d}{end()}")(at(), dot())
    good = (
        lambda: ("email", spelled(), ("mail", "contact", "write to", "reach me:", "", "")),
        lambda: ("email", f"{local()} @ {word()}.{end()}", ("email", "mail", "address", "")),
        lambda: ("phone", f"({some(3)}) {some(3)}{r.choice('- .')}{num(4)}", ("call", "phone", "tel", "mobile", "", "")),
        lambda: ("phone", f"{some(3)}{(s := r.choice('-. '))}{some(3)}{s}{num(4)}", ("call", "phone", "tel.", "dial", "text")),
        lambda: ("phone", f"0{some(r.randint(2, 4))}{r.choice((' ', '/', '-', ' / '))}{some(r.randint(5, 8))}", ("ring", "Tel:", "phone", "fax", "", "mobile")),
        lambda: ("phone", f"0{some(1)}{(s := r.choice(' .'))}" + s.join(num(2) for _ in range(4)), ("call", "tel", "mobile", "")),
        lambda: ("phone", f"(0{some(3)}) {some(r.randint(5, 8))}", ("ring", "tel", "phone", "")),
        lambda: ("ip", r.choice(("[.]", " . ", "[.]")).join(str(r.randint(1, 255)) for _ in range(4)), ("host", "server", "login from", "ip", "")),
        lambda: ("card", r.choice((" / ", ".", "_", "  ", " - ", "/")).join(re.findall("....", card())), ("card", "visa", "credit card", "payment", "")),
    )
    bad = (
        lambda: ("phone", f"{year()}{(s := r.choice('-/.'))}{r.randint(10, 12)}{s}{r.randint(10, 28)}", ("date", "on", "year", "", "call")),
        lambda: ("phone", f"{r.randint(10, 28)}{(s := r.choice('/.-'))}{r.randint(10, 12)}{s}{year()}", ("date", "on", "", "phone")),
        lambda: ("phone", f"({year()}) {year()}{r.choice('-/')}{year()}", ("the year", "since", "between", "")),
        lambda: ("phone", f"{r.choice(('', '('))}{year()}{r.choice(('-', ' - ', '/', ' '))}{year()}", ("in", "the years", "from", "", "")),
        lambda: ("phone", f"{some(r.randint(2, 4))}{r.choice((' ', '-', '/', '. '))}{some(r.randint(2, 4))}", ("pages", "score", "section", "figure", "", "", "", "of")),
        lambda: ("phone", f"{some(3)}-{some(2)}-{some(5)}", ("isbn", "order", "id", "invoice", "build")),
        lambda: ("phone", grouped([r.randint(2, 5) for _ in range(r.randint(3, 5))], r.choice((" ", " ", "/"))), ("rows", "table", "measured", "", "total", "sum of")),
        lambda: ("ip", " ".join(some(2) for _ in range(3)) + ". " + some(2), ("table", "scores", "")),
        lambda: ("ip", " . ".join(some(3) for _ in range(4)), ("table", "ratio", "section")),
        lambda: ("card", r.choice((" ", "  ", ".", " / ", "-")).join((some(4), num(4), num(4))), ("order", "table", "invoice", "figures", "")),
        lambda: ("card", r.choice((" ", "-", ".", "_", " / ", "  ")).join(re.findall("....", card(False))), ("order", "rows", "", "table", "id", "serial")),
        lambda: ("card", "-".join((some(4), num(4), num(4), num(5))), ("order", "build", "id", "")),
        lambda: ("email", f"{word()}{r.choice((' (at) ', ' at '))}{word()}. {r.choice((word(), 'The', 'In', 'And'))}", ("met", "stood", "", "looked", "arrived")),
        lambda: ("email", f"{word()} at {word()}. {word().title()} {word()}", ("", "met", "we were", "")),
        lambda: ("email", f"{word()} at {word()} dot {word()}", ("looked", "", "drew")),
    )
    while len(out) < n:
        label = int(r.random() < 0.5)
        kind, body, cues = r.choice(good if label else bad)()
        cue = r.choice(cues)
        text = f"{prose(r.randint(0, 6))} {cue}{' ' if cue else ''}".lstrip()
        at_, text = len(text), f"{text}{body}{r.choice((' ', ' ', ', ', '. '))}{prose(r.randint(1, 6))}"
        found = []
        for k, a, b in candidates(text):
            if a < at_ + len(body) and b > at_:
                whole = k == kind and a <= at_ and b >= at_ + len(body)
                found.append((text, k, a, b, int(bool(label) and whole)))
        if found:
            out.append(found)
    return out


class Model:
    """The fitted trees, the calibration of their score and a threshold for each kind."""

    def __init__(self, sentences: int = SENTENCES, seed: int = 7) -> None:
        parts: list[list] = [[], [], []]
        for i, rows in enumerate(labelled_sentences(sentences, seed)):
            parts[(0, 1, 0, 2)[i % 4]] += rows
        x, y = zip(*((np.array([features(*row[:4]) for row in part]), np.array([row[4] for row in part], float)) for part in parts), strict=True)
        self.trees = Trees().fit(x[0], y[0])
        s, t = self.trees.score(x[1]), y[1]
        a, b = 1.0, 0.0
        for _ in range(50):  # Platt scaling by Newton's method
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - t) * s).sum() + 1e-3 * (a - 1), (p - t).sum()])
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-9]])
            da, db = np.linalg.solve(hess, grad)
            a, b = a - da, b - db
        self.a, self.b = float(a), float(b)
        p, self.thresholds = self.probability(x[2]), {}
        for n, kind in enumerate(KINDS):
            mine = x[2][:, 0] == n
            order = np.argsort(-p[mine], kind="stable")
            precision = np.cumsum(y[2][mine][order]) / np.arange(1, mine.sum() + 1)
            enough = np.flatnonzero((precision >= PRECISION) & (p[mine][order] >= 0.5))
            self.thresholds[kind] = float(p[mine][order][enough[-1]]) if len(enough) else 1.1

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.trees.score(x) + self.b)))


_model: list[Model] = []


def model() -> Model:
    """Fitted once in the process that first asks."""
    if not _model:
        _model.append(Model())
    return _model[0]


def find(text: str, fitted: Model | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start."""
    base = base_spans(text)
    loose = _clear(candidates(text), base)
    if not loose:
        return base, base
    fitted = fitted or model()
    p = fitted.probability(np.array([features(text, *c) for c in loose]))
    kept: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    for i in sorted(range(len(loose)), key=lambda i: (-p[i], loose[i][1], loose[i][2])):
        kind, a, b = loose[i]
        if p[i] < fitted.thresholds[kind]:
            continue
        at = bisect.bisect(taken, (a, b))
        if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
            continue
        taken.insert(at, (a, b))
        kept.append(loose[i])
    return base, sorted({*base, *kept}, key=lambda s: (KINDS.index(s[0]), s[1]))


def _clear(loose: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose spans that overlap no base span."""
    runs: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    starts = [a for a, _ in runs]
    return [c for c in loose if not ((i := bisect.bisect_left(starts, c[2])) and runs[i - 1][1] > c[1])]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its first kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out.append(f"{text[done:a]}[{kind.upper()}]")
        done = max(done, b)
    return "".join(out) + text[done:]


SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(with_text: bool, shared):
    """Counts, digest and spans of each text, and with_text the redacted text; other columns as they are."""

    def run(batches):
        import pyarrow as pa

        fitted = shared.value
        for batch in batches:
            texts = batch.column("text")
            rows: list[list] = [[] for _ in range(7 if with_text else 6)]
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                base, spans = find(text, fitted)
                kinds = [k for k, _, _ in base]
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                for column, value in zip(rows, [*row, redact(text, spans)] if with_text else row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * (3 if with_text else 2)
            keep = [c for c in batch.schema.names if c != "text"]
            names = [*keep, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *(["text"] if with_text else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v, t) for v, t in zip(rows, types, strict=True))], names=names)

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model())
    return docs.select("doc_id", "text").mapInArrow(_scan(False, shared), f"doc_id {dict(docs.dtypes)['doc_id']}, {SPANS}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the spans in `text` replaced by their kinds; a null text stays null; columns and their order stay."""
    names = {c: f"c{n}" for n, c in enumerate(docs.columns)}
    rest = [F.col(f"`{c}`").alias(n) for c, n in names.items() if c != "text"]
    carried = docs.select(F.struct(*rest, F.col("text").isNull().alias("none")).alias("_row"), "text")
    schema = f"_row {dict(carried.dtypes)['_row']}, {SPANS}, text string"
    out = carried.mapInArrow(_scan(True, docs.sparkSession.sparkContext.broadcast(model())), schema)
    text = F.when(~F.col("_row.none"), F.col("text")).alias("text")
    return out.select(*[text if c == "text" else F.col(f"_row.{n}").alias(c) for c, n in names.items()])
