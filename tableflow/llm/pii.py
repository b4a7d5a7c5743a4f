"""Personal data by boosted trees over candidate spans.

Fixed patterns give the base spans, which always stay. Generators with high
recall propose further spans, which may overlap each other and the base: mail
addresses with spelled-out signs, numbers with any separators and the pieces of
long runs of them, numbers in four parts. Boosted trees score every proposal by
its format and its context.

They learn from spans whose nature is known. Personal data: the base spans of a
sample of the corpus as they are and disguised the way people do it, and spans
made in the usual notations. Not personal data: numbers that only look alike,
made as well (dates, amounts, ISBNs, order and serial numbers, versions, lists,
ranges, prose with an ``at``), and proposals that a base span of another kind
covers. Any other proposal of the corpus is of unknown nature and teaches
nothing. A threshold per kind, calibrated on spans that the trees have not
seen, lies above every wrong one of them; a kind with too few spans to tell
adds none.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import in_arrow

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE_DOCS, SAMPLE_SPANS = 4000, 20_000
CONTEXT = 24
MADE = 6000  # spans made for learning, half of them personal data
ENOUGH = 40  # right and wrong spans of a kind that calibration needs of each

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, ``@`` and domain, found from each ``@`` so that long words cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", max(at + 1, free))


def _part_ok(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) <= 3 and int(kept or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """All matches of the fixed patterns that pass their checks, by kind and then start."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_part_ok, m.group().split(".")))]
    for match in CARD.finditer(text):
        number = _digits(match.group())
        if 16 <= len(number) <= 19 and luhn(number):
            found.append(("card", match.start(), match.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


SIGN = re.compile(r"@|[\[({]\s?at\s?[\])}]|(?<=\w) at (?=\w)", re.I)
BEFORE = re.compile(r"[\w.%+-]{1,64}\s?\Z")
BEHIND = re.compile(r"\s?[\w-]{1,63}(?:(?:\s?(?:\.|[\[({]\s?(?:dot|\.)\s?[\])}])\s?|\sdot\s)[\w-]{1,63}){1,5}", re.I)
NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9][0-9\x20().,/-]{5,}[0-9]")
PIECE = re.compile(r"[+(]{0,2}[0-9](?:(?![,;/]\x20|\x20-\x20|\x20\x20)[0-9\x20().,/-])*[0-9]")
QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:[.,]|[\[({]\s?(?:\.|dot)\s?[\])}])\s?[0-9]{1,3}){3}(?![0-9])", re.I)


def _numbers(text: str, start: int, end: int) -> Iterator[Span]:
    digits = _digits(text[start:end])
    if 12 <= len(digits) <= 19 and luhn(digits):  # what fails the check is no card
        yield "card", start, end
    if 7 <= len(digits) <= 15:
        yield "phone", start, end


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data, overlapping ones among them. A run of several numbers gives itself and its pieces."""
    found = []
    for sign in SIGN.finditer(text):
        left = BEFORE.search(text, max(0, sign.start() - 66), sign.start())
        right = BEHIND.match(text, sign.end(), sign.end() + 400)
        if left and right:
            found.append(("email", left.start(), right.end()))
    for match in NUMBER.finditer(text):
        found += _numbers(text, match.start(), match.end())
        for piece in PIECE.finditer(text, match.start(), match.end()):
            if piece.span() != match.span():
                found += _numbers(text, *piece.span())
    found += [("ip", m.start(), m.end()) for m in QUAD.finditer(text)]
    return found


# Words before a span that speak for its kind, and words that speak for another number.
HINTS = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "addr", "ping"),
    "card": ("card", "visa", "credit", "pay", "master"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "dial", "reach"),
}
OTHER = (
    "isbn", "ean", "order", "serial", "version", "release", "ref", "invoice", "date", "total", "amount", "sum", "usd", "eur", "$",
    "id", "no.", "number", "page", "between", "from", "ticket", "account", "score", "list", "step", "section",
)
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][01]?[0-9][-./][0-3]?[0-9]|[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)[0-9]{2}")
THOUSANDS = re.compile(r"[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]{1,2})?")


def features(text: str, span: Span) -> list[float]:
    """Format of the span and of its surroundings; the checks of the base patterns are not among them but for Luhn."""
    kind, start, end = span
    own, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = re.findall(r"[0-9]+", own) or [""]
    sizes = [len(x) for x in groups]
    digits = sum(sizes)
    values = [int(x[-9:] or 0) for x in groups]
    near = left.lower()
    words = re.findall(r"[^\W\d_]+", own.lower()) or [""]
    seps = set(re.sub(r"[0-9A-Za-z]", "", own))
    return [
        len(own), digits, len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], digits / max(len(own), 1), len(seps),
        own.count(" "), own.count("."), own.count("-"), own.count("(") + own.count(")") + own.count("["), own.count(","), own.count("/"),
        own.count(", ") + own.count(" - "), float("@" in own), float(own[:1] == "+"), float(own[:1] == "("), float(own[:2] == "00"),
        float(own[:1] == "0"), float(max(values) <= 255), float(max(values) >= 32), float(values == sorted(values)),
        float(bool(digits) and luhn(_digits(own))), float(bool(DATE.search(own))), float(bool(THOUSANDS.fullmatch(own))),
        float(_digits(own)[:3] in ("978", "979")), float(own.lower().count("dot")), float(" at " in own.lower()), float(words[-1] in ENDINGS),
        len(words), max(map(len, words)), float(left[-1:].isalnum()), float(right[:1].isalnum()), float(right[:1] == ":"),
        float(right[:2].strip()[:1].isdigit()), float(left[-2:].strip()[-1:].isdigit()),
        sum(c.isdigit() for c in left + right) / max(len(left + right), 1),
        float(any(h in near for h in HINTS[kind])), float(any(h in near for h in OTHER)), float(KINDS.index(kind)),
    ]


def disguises(text: str, span: Span) -> Iterator[tuple[str, Span]]:
    """A base span rewritten the way people write around filters, in its own context."""
    kind, start, end = span
    own = text[start:end]
    ways = {
        "email": [own.replace("@", " (at) "), own.replace("@", "[at]").replace(".", " (dot) "), own.replace("@", " at ").replace(".", " dot ")],
        "ip": [own.replace(".", " . "), own.replace(".", "[.]")],
        "card": [re.sub(r"(?<=[0-9])(?=(?:[0-9]{4})+$)", ".", _digits(own)), "/".join(re.findall(r"[0-9]{1,4}", _digits(own)))],
        "phone": ["00" + _digits(own), "00" + re.sub(r"[^0-9]+", " ", own.lstrip("+"))],
    }
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    for way in ways[kind]:
        yield left + way + right, (kind, len(left), len(left) + len(way))


def _pattern(draw: random.Random, form: str) -> str:
    """``form`` with a digit for every ``#`` and one above zero for every ``%``."""
    return re.sub("[#%]", lambda m: str(draw.randint(m.group() == "%", 9)), form)


def _card(draw: random.Random) -> str:
    number = draw.choice("3456") + _pattern(draw, "#" * draw.choice([12, 13, 14, 14, 14]))
    return next(number + str(d) for d in range(10) if luhn(number + str(d)))


# Usual notations: ``#`` is any digit, ``%`` one above zero.
PHONES = (
    "%##-%##-####", "(%##) %##-####", "(%##)%##-####", "%##.%##.####", "%## %## ####", "1-8##-%##-####", "00%# %# #### ####", "00%#%########",
    "00%# %## %######", "0%##/%######", "0%# ## ## ## ##", "0%###-%#####", "+%# (0)%## %######", "0%## %### ####",
)
NUMBERS = (
    "19##-0%-1#", "20##-0%-2#", "20##-1#-0%", "2%.0%.20##", "0%/1#/19##", "20##-0%-1# 1#", "20##-0%-0% 0#", "20##/0%/2#", "%,###,###", "%#,###,###",
    "%.###.###,##", "%###,###.##", "%,###,### - %,###,###", "%###### - %######", "978-%-%##-#####-#", "978%#########", "979##########", "%-%##-#####-#",
    "%######", "%#######", "%########", "%#########", "%##########", "%###########", "%############", "%##############", "%###############",
    "%###-%###", "%##, %##, %##", "%#, %#, %#, %#", "%, %, %, %", "%,%,%,%", "%.#, %.#, %.#, %.#", "%##.####, %.####", "19##-19##, 20##", "%####-####",
    "%#/%#/%#/%#", "%###/%###", "%##-%##, %##-%##", "%##.%##,##", "%## %##", "%### %### %###", "%.%.%, %.%.%", "%#-%#-%#-%#",
)
NAMES = ("john", "anna.k", "m_weber", "sales", "info", "j-doe7", "office", "x.y", "lee", "support", "claire99", "no.reply")
HOSTS = ("example", "mail", "corp", "my-site", "uni", "acme", "web", "post", "firm24", "lab")
PROSE = (
    "look (at) this. Then go", "meet @ noon. Tomorrow is", "we arrived at six. Later they", "sold @ 3.50 each", "5 (at) 2.50 apiece",
    "stay at home dot the end", "aim at it. Fire", "good at maths. She", "draw at point dot line", "look at the. end", "stop at red. Go at green",
    "he laughed at me. Why", "paid at once. In full", "(at) last. It was", "is at stake. Nothing",
)
LEADS_OTHER = (
    "ISBN ", "ISBN: ", "EAN ", "order ", "order no. ", "serial ", "version ", "release ", "ref. ", "invoice ", "dated ", "total ", "sum of ", "USD ", "$",
    "id ", "no. ", "pages ", "between ", "from ", "ticket ", "account ", "scores ", "steps ", "section ", "on ", "in ", "of ", "about ", "and ", "the ", "",
)


def made(draw: random.Random, words: list[str]) -> tuple[str, Span, float]:
    """A text made of some words around a span that is personal data (1.0) or only looks so (0.0)."""
    kind, yes = draw.choice(KINDS), draw.random() < 0.5
    about = " ".join(draw.choices(words, k=3))
    if yes:
        lead = about + " " + (draw.choice(HINTS[kind]) + draw.choice([" ", ": ", " me ", " at "]) if draw.random() < 0.6 else "")
        if kind == "phone":
            own = _pattern(draw, draw.choice(PHONES))
        elif kind == "card":
            own = re.sub(r"(?<=[0-9])(?=(?:[0-9]{4})+$)", draw.choice([".", "/", " ", "-", ". "]), _card(draw))
        elif kind == "ip":
            dot = draw.choice(["[.]", "(.)", " . ", " [.] ", "[dot]", " (dot) "])
            own = dot.join(str(draw.randint(0, 255)) for _ in range(4))
        else:
            at, dot = draw.choice([("(at)", "."), (" (at) ", " dot "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("@", " (dot) "), (" [at] ", " [dot] ")])
            own = dot.join([draw.choice(NAMES) + at + draw.choice(HOSTS), draw.choice(ENDINGS)])
    else:
        lead = about + " " + (draw.choice(LEADS_OTHER) if draw.random() < 0.8 else "")
        own = draw.choice(PROSE) if kind == "email" else _pattern(draw, draw.choice(NUMBERS))
        if kind == "card" and draw.random() < 0.5:  # one number in ten passes the check of cards by chance
            own = next(n for n in iter(lambda: _pattern(draw, "%" + "#" * draw.randint(11, 14)), "") if luhn(n))
    tail = draw.choice([" ", ". ", ", ", ":30:45 " if "-" in own else " ", ""]) + " ".join(draw.choices(words, k=2))
    return lead + own + tail, (kind, len(lead), len(lead) + len(own)), float(yes)


def made_examples(words: list[str], n: int = MADE, seed: int = 11) -> Iterator[tuple[list[float], float, str]]:
    """The proposals in ``n`` made texts: right where they are the span made, wrong in texts without personal data."""
    draw = random.Random(seed)
    for _ in range(n):
        text, place, yes = made(draw, words)
        for span in dict.fromkeys(proposals(text)):
            if yes and span == place:
                yield features(text, span), 1.0, span[0]
            elif not yes or (span[0] != place[0] and span[1] < place[2] and place[1] < span[2]):
                yield features(text, span), 0.0, span[0]


@dataclass
class Trees:
    """Boosted trees of fixed depth: per tree the feature and cut of each inner node, and the value of each leaf."""

    feature: np.ndarray
    cuts: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cuts, value in zip(self.feature, self.cuts, self.value):
            node = np.zeros(len(x), int)
            while len(x) and node[0] < len(feature):  # all rows are at the same depth
                node = 2 * node + 1 + (x[rows, feature[node]] > cuts[node])
            out += value[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss; cuts at the quantiles of each feature."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    margin, inner = np.full(len(x), start), 2**depth - 1
    features, cut_rows, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        pull, weight = y - p, p * (1 - p)
        node = np.zeros(len(x), int)
        feature, cuts = np.zeros(inner, int), np.full(inner, np.inf)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best, total, mass = 1e-6, pull[own].sum(), weight[own].sum()
            for f, places in enumerate(grid):
                for place in places:
                    right = own[x[own, f] > place]
                    g, h = pull[right].sum(), weight[right].sum()
                    gain = g * g / (h + ridge) + (total - g) ** 2 / (mass - h + ridge) - total**2 / (mass + ridge)
                    if gain > best:
                        best, feature[k], cuts[k] = gain, f, place
            node[own] = 2 * k + 1 + (x[own, feature[k]] > cuts[k])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=pull, minlength=inner + 1) / (np.bincount(leaf, weights=weight, minlength=inner + 1) + ridge)
        margin += value[leaf]
        features.append(feature)
        cut_rows.append(cuts)
        values.append(value)
    return Trees(np.array(features), np.array(cut_rows), np.array(values), start)


@dataclass
class PiiModel:
    trees: Trees
    limits: dict[str, float]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans and spans the trees add, each by kind and start. Added spans do not overlap a span of their kind."""
        base = base_spans(text)
        tried = proposals(text)
        taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
        covered = set(base)
        tried = [s for s in dict.fromkeys(tried) if s not in covered]
        if not tried:
            return base, []
        margins = self.trees.margin(np.array([features(text, s) for s in tried], float))
        added = []
        for score, span in sorted(zip(margins.tolist(), tried), key=lambda x: (-x[0], x[1])):
            kind, start, end = span
            if score >= self.limits[kind] and all(end <= a or start >= b for a, b in taken[kind]):
                taken[kind].append((start, end))
                added.append(span)
        order = {k: i for i, k in enumerate(KINDS)}
        return base, sorted(added, key=lambda s: (order[s[0]], s[1]))


def _examples(text: str) -> Iterator[tuple[list[float], float, str]]:
    base = base_spans(text)
    for span in proposals(text):
        kind, start, end = span
        over = [k for k, a, b in base if a < end and start < b]
        if (kind, start, end) in base:
            yield features(text, span), 1.0, kind
        elif over and kind not in over:
            yield features(text, span), 0.0, kind
    for span in base:
        for changed, place in disguises(text, span):
            if place in proposals(changed):
                yield features(changed, place), 1.0, span[0]


def fit(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> PiiModel:
    """Fit on made spans and on those of about ``sample_docs`` documents that hold a digit or an ``@``, at most ``sample_spans``.

    The documents are taken by a hash of their text, so copies come and go
    together. The same documents give the same model.
    """
    able = docs.select(docs[text].alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = able.count()
    taken = able.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < -(-(sample_docs << 20) // max(n, 1)))

    def run(batches):
        for batch in batches:
            rows = [(x, y, kind) for value in batch.column("text").to_pylist() for x, y, kind in _examples(value)]
            columns = list(zip(*rows)) or [(), (), ()]
            held = [np.asarray(x, "<f8").tobytes() for x in columns[0]]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.string())], ["x", "y", "kind"])

    rows = in_arrow(taken, run, "x binary, y double, kind string").orderBy(F.xxhash64("x", "y"), "x").limit(sample_spans).collect()
    rows = [(np.frombuffer(r.x, "<f8"), r.y, r.kind) for r in rows]
    rows += [(np.array(x), y, kind) for x, y, kind in made_examples(["and", "the", "of", "alpha", "noch", "para", "avec", "see", "thing"])]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    kinds, check = np.array([r[2] for r in rows]), np.arange(len(rows)) % 4 == 0
    trees = boost(x[~check], y[~check], trees=60)
    margins, limits = trees.margin(x), {}
    for kind in KINDS:
        own = check & (kinds == kind)
        right, wrong = margins[own & (y == 1)], margins[own & (y == 0)]
        enough = min(len(right), len(wrong)) >= ENOUGH
        limits[kind] = max(float(wrong.max()) + 1e-9, 0.0) if enough else np.inf
    return PiiModel(trees, limits)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: PiiModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the number of base spans of each kind, base_sha256, spans, n_added.

    Spans are ``kind:start:end`` in code points, the end not included, by kind
    and then start; ``spans`` has the base ones and those the trees add, and
    ``base_sha256`` is the digest of the base ones. NULL counts as empty, which
    has no span. Repeated rows give repeated rows; further columns play no part.
    """
    handed = docs.sparkSession.sparkContext.broadcast(model)  # a few trees

    def run(batches):
        order = {k: i for i, k in enumerate(KINDS)}
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                base, added = handed.value.spans(value.as_py() or "")
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                whole = sorted(base + added, key=lambda s: (order[s[0]], s[1]))
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(whole), len(added)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return in_arrow(named, run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every stretch that spans cover replaced by the kind of its first span, as in ``<EMAIL>``."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; NULL stays NULL, other columns stay as they are."""
    handed = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    place = columns.index(text)

    def run(batches):
        for batch in batches:
            texts = []
            for value in batch.column(place):
                value = value.as_py()
                texts.append(value if value is None else redacted(value, sum(handed.value.spans(value), [])))
            arrays = [pa.array(texts, batch.schema.field(place).type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return in_arrow(docs, run, docs.schema)
