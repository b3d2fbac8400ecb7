"""Personal data: candidate spans, boosted trees on format and context, calibrated thresholds."""

from __future__ import annotations

import bisect
import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import text_of

#: Kinds in their order; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Share of wrong spans that a threshold allows among those taken, in forms that the trees have not seen.
WRONG = 0.1

_AT = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[0-9]")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        c -= 48
        total += c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c)
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of what the base patterns find, leftmost and disjoint per kind.

    The patterns are run from what they cannot do without, in time linear in the text: an e-mail
    is looked for at each at sign and extended to the left; a number begins where a run of
    digits does, since no match can begin within a run of which the first digit failed.
    """
    out = []
    if b"@" in text:
        free = 0
        for m in _AT.finditer(text):
            lo = m.start()
            while lo > free and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < m.start():
                out.append((0, lo, m.end()))
                free = m.end()
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(b" ", b"").replace(b"-", b"")) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if b"+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


#: Generators of candidates: a kind and a pattern that is generous. They may overlap. Runs are
#: of any length and possessive, so that the time is linear in the text.
_GENERATORS = (
    (0, re.compile(rb"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:[ ]?(?:\(at\)|\[at\])[ ]?| at )[A-Za-z0-9-]++(?:(?:[ ]?(?:\(dot\)|\[dot\])[ ]?| dot |\.)[A-Za-z0-9-]{2,}+)++")),
    (1, re.compile(rb"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}+:){1,7}+(?::(?:[0-9A-Fa-f]{1,4}+:){0,6}+)?[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])")),
    (2, re.compile(rb"(?<![0-9.,-])[0-9]{4}+[ .-][0-9]{4,6}+[ .-][0-9]{4,5}+(?:[ .-][0-9]{3,4}+)?(?![0-9])")),
    (3, re.compile(rb"(?<![0-9.,-])(?:\+?[0-9]{1,3}+[ .-])?\(?[0-9]{2,4}+\)?[ ./-][0-9]{3,4}+[ .-][0-9]{3,4}+(?![0-9.,-])")),
    (3, re.compile(rb"(?<![0-9A-Za-z.,/+-])\(?0[0-9]{1,5}+\)?(?:[ ./-]{1,2}[0-9]{2,8}+){1,6}+(?![0-9A-Za-z/-]|[.,][0-9])")),
    (4, re.compile(rb"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+=?")),
)
_MAY_AT = re.compile(rb"(?i)[ (\[]at[ )\]]")
# Fixed choices: words that speak for a kind ahead of a span, and against it.
_WORDS = ((b"mail", b"contact", b"write", b"reach"), (b"ip", b"host", b"addr", b"server", b"ping", b"route"), (b"card", b"visa", b"pay", b"credit"), (b"phone", b"tel", b"call", b"fax", b"mobil", b"dial"), (b"key", b"token", b"secret", b"passw", b"auth", b"bearer", b"credential"))
_AGAINST = ((b"look", b"arriv", b"star", b"shop", b"meet"), (b"time", b"clock", b"score", b"ratio", b"verse", b"namespace"), (b"serial", b"order", b"invoice"), (b"date", b"page", b"isbn", b"order", b"total", b"version", b"year", b"invoice", b"between"), (b"commit", b"image", b"sha", b"md5", b"digest", b"checksum", b"revision", b"blob", b"etag", b"uuid", b"build", b"version", b"path", b"file", b"order", b"serial"))
_ENDINGS = frozenset((b"com", b"org", b"net", b"edu", b"gov", b"info", b"io", b"de", b"fr", b"es", b"it", b"uk", b"eu", b"nl", b"ch", b"at", b"us", b"ca", b"au", b"jp", b"biz", b"name"))
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DATE = re.compile(rb"(?:.*[^0-9])?(?:19|20)[0-9]{2}[-_./]?[01][0-9][-_./]?[0-3][0-9]")
#: Bytes of context that features look at.
AHEAD, BEHIND = 32, 8


_KEY_BYTES = np.zeros(256, bool)
_KEY_BYTES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+-"]] = True


def needs(text: bytes) -> list[bool]:
    """For each generator whether the text holds what its pattern can't do without."""
    ends = np.flatnonzero(~_KEY_BYTES[np.frombuffer(text, np.uint8)])
    longest = int(np.diff(ends, prepend=-1, append=len(text)).max()) - 1
    digit = _DIGITS.search(text) is not None
    return [_MAY_AT.search(text) is not None, text.count(b":") > 1, digit, digit, digit, longest >= 16]


def candidates(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every span that a generator proposes."""
    return [(kind, m.start(), m.end()) for (kind, pattern), may in zip(_GENERATORS, needs(text), strict=True) if may for m in pattern.finditer(text)]


def describe(kind: int, span: bytes, before: bytes, after: bytes) -> list[float]:
    """Features of a candidate: its kind, its format, what stands around it."""
    n = len(span)
    digit = sum(48 <= c <= 57 for c in span)
    lower, upper = sum(97 <= c <= 122 for c in span), sum(65 <= c <= 90 for c in span)
    hexed = sum(48 <= c <= 57 or 97 <= c <= 102 or 65 <= c <= 70 for c in span)
    counts = np.bincount(np.frombuffer(span, np.uint8), minlength=1)
    share = counts[counts > 0] / max(n, 1)
    groups = [len(x) for x in re.split(rb"[^0-9]+", span) if x]
    only = bytes(c for c in span if 48 <= c <= 57)
    changes = sum((48 <= a <= 57) != (48 <= b <= 57) for a, b in zip(span, span[1:], strict=False))
    low, name = before.lower(), span.lower()
    vowels = sum(c in b"aeiouAEIOU" for c in span)
    letters = [x for x in re.split(rb"[^a-z]+", name) if x]
    cases = sum(97 <= a <= 122 and 65 <= b <= 90 for a, b in zip(span, span[1:], strict=False))
    ladder = sum(b - a in (0, 1) for a, b in zip(name, name[1:], strict=False)) / max(n - 1, 1)
    colons = re.split(rb":+", span)
    return [
        float(any(w in low for w in _AGAINST[kind])), float(b"(at)" in name or b"[at]" in name), float(b" dot " in name or b"(dot)" in name or b"[dot]" in name), float(bool(letters) and letters[-1] in _ENDINGS), len(letters[-1]) if letters else 0, max(map(len, letters), default=0),
        float(b"::" in span), len(colons), max(map(len, colons)), min(map(len, colons)), float(span[:1] == b"0" or span[:2] == b"(0"), float(_UUID.fullmatch(span) is not None), float(_DATE.match(span) is not None), cases, ladder, float(hexed == n and n in (32, 40, 64, 128)), span.count(b"_"), span.count(b" "), len(set(span) & set(b" ./-")), len(letters), upper,
        kind, n, digit, digit / max(n, 1), lower / max(n, 1), upper / max(n, 1), hexed / max(n, 1), float(-(share * np.log2(share)).sum()), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0,
        float(13 <= digit <= 19 and luhn(only)), changes, span.count(b":"), span.count(b"."), span.count(b"-"), span.count(b"/") + span.count(b"+"), float(b"(" in span), float(b"at" in span.lower()) + float(b"dot" in span.lower()),
        float(any(w in low for w in _WORDS[kind])), float(low[-2:].strip()[-1:] in (b":", b"=", b'"', b"'")), float(after[:1].isalnum()), float(groups[:1] == [4] and 1900 <= int(only[:4] or b"0") <= 2099), vowels / max(n, 1),
    ]


# ---------------------------------------------------------------- boosted trees


class Boosted:
    """Gradient-boosted regression trees of the logistic loss, on binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        f = np.full(len(y), self.start)
        self.model = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                made = []
                for node in range(1 << level):
                    rows = np.flatnonzero(leaf == node)
                    made.append(self._split(binned[rows], g[rows], h[rows]) if len(rows) >= 2 * self.least else (0, self.bins))
                splits.append(made)
                feature, cut = np.array(made)[leaf].T
                leaf = leaf * 2 + (binned[np.arange(len(y)), feature] > cut)
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1.0)
            self.model.append((splits, value))
            f += value[leaf]
        return self

    def _split(self, b, g, h):
        n, columns = b.shape
        flat = (b + np.arange(columns) * self.bins).ravel()
        gs, hs, ns = (np.bincount(flat, np.repeat(w, columns), columns * self.bins).reshape(columns, self.bins).cumsum(axis=1) for w in (g, h, np.ones(n)))
        total_g, total_h = g.sum(), h.sum()
        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
        gain[(ns < self.least) | (n - ns < self.least)] = 0
        j, k = np.unravel_index(int(gain.argmax()), gain.shape)
        return (int(j), int(k)) if gain[j, k] > 1e-9 else (0, self.bins)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for splits, value in self.model:
            leaf = np.zeros(len(x), np.int64)
            for made in splits:
                feature, cut = np.array(made)[leaf].T
                leaf = leaf * 2 + (binned[rows, feature] > cut)
            f += value[leaf]
        return 1 / (1 + np.exp(-f))


class _Forms:
    """Makers of invented spans, by kind and label: each form is one way to write one. Names, hosts
    and keys are drawn anew; forms of both labels share them, so that only the form, the
    format and the context can tell them apart."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, chars: str, k: int) -> str:
        return "".join(self.rng.choice(list(chars), k))

    def digits(self, k: int) -> str:
        return self.pick("0123456789", k)

    def one(self, *of) -> str:
        return str(of[int(self.rng.integers(len(of)))])

    def word(self, most: int = 4) -> str:
        return "".join(self.rng.choice(["th", "er", "an", "on", "le", "que", "ver", "cht", "in", "os", "ra", "mi", "ka", "lo", "su", "den", "ro", "ja"], self.rng.integers(1, most + 1)))

    def local(self) -> str:
        a, b = self.word(), self.word()
        return self.one(f"{a}.{b}", a, f"{a[0]}{b}", f"{a}_{b}", f"{a}+{b}", f"{a}{self.digits(2)}", f"{a}.{b}{self.digits(1)}", f"{a[0]}.{b}", f"{a}-{b}")

    def host(self) -> str:
        return self.one(self.word(), f"{self.word()}-{self.word()}", f"{self.word()}{self.digits(1)}")

    def end(self) -> str:
        return self.one("com", "org", "net", "de", "fr", "es", "io", "info", "edu", "uk")

    def group(self, k: int = 4) -> str:
        return self.pick("0123456789abcdef", int(self.rng.integers(1, k + 1)))

    def card(self, good: bool, mark: str) -> str:
        d = self.digits(15)
        last = next(c for c in "0123456789" if luhn((d + c).encode()) == good)
        return mark.join((d + last)[i : i + 4] for i in (0, 4, 8, 12))

    def forms(self) -> dict[tuple[int, bool], list]:
        hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        b64 = upper + upper.lower() + "0123456789"
        w, d, p, r = self.word, self.digits, self.pick, self.rng
        length = lambda: int(r.choice([32, 40, 64]))
        return {
            (0, True): [lambda: f"{self.local()}(at){self.host()}.{self.end()}", lambda: f"{self.local()}[at]{self.host()}.{self.end()}", lambda: f"{self.local()} at {self.host()} dot {self.end()}", lambda: f"{self.local()}(at){self.host()}(dot){self.end()}", lambda: f"{self.local()}[at]{self.host()}[dot]{self.end()}", lambda: f"{self.local()} (at) {self.host()} (dot) {self.end()}", lambda: f"{self.local()} [at] {self.host()} [dot] {self.end()}", lambda: f"{self.local()} at {self.host()} dot co dot {self.end()}"],
            (0, False): [lambda: f"{w()} at {w()}.{w()}", lambda: f"{w()} at {self.host()}.{self.end()}", lambda: f"{w()} at {w()} dot {w(3)}{w(3)}", lambda: f"{w()} at {d(2)}.{d(2)}", lambda: f"{w()}(at){d(1)}.{d(2)}", lambda: f"{w()} at {w()}.{d(3)}"],
            (1, True): [lambda: ":".join(p(hexa, 4) for _ in range(8)), lambda: f"2001:db8::{self.group()}", lambda: "fe80::" + ":".join(self.group() for _ in range(int(r.integers(1, 5)))), lambda: f"{p(hexa, 4)}:{p(hexa, 4)}:{self.group()}::{self.group()}", lambda: ":".join(self.group() for _ in range(8)), lambda: f"2{p(hexa, 3)}:{p(hexa, 3)}::{self.group()}:{self.group()}"],
            (1, False): [lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: ":".join(d(1) for _ in range(int(r.integers(3, 7)))), lambda: ":".join(d(2) for _ in range(int(r.integers(3, 6)))), lambda: f"{p('abcdef', 3)}::{p('abcdef', 3)}", lambda: f"{d(1)}:{d(2)}:{d(2)}", lambda: f"{p('abcdef', 1)}::{p('abcdef', 4)}"],
            (2, True): [lambda: self.card(True, "."), lambda: self.card(True, "-"), lambda: self.card(True, " ")],
            (2, False): [lambda: self.card(False, "."), lambda: self.card(False, "-"), lambda: self.card(False, " ")],
            (3, True): [lambda: f"({d(3)}) {d(3)}{self.one('-', ' ', '.')}{d(4)}", lambda: f"{p('23456789', 1)}{d(2)}-{d(3)}-{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(2)} {d(7)}", lambda: f"0{d(3)}/{d(6)}", lambda: f"0{d(3)}-{d(7)}", lambda: f"({'0' + d(2)}) {d(6)}", lambda: f"{p('23456789', 1)}{d(2)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(4)}"],
            (3, False): [lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: f"20{d(2)} 100 {d(3)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"19{d(2)}-{d(3)}-{d(3)}", lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"0{d(1)}-{self.one('0', '1')}{d(1)}-{d(4)}", lambda: f"0{d(1)}.{self.one('0', '1')}{d(1)}.20{d(2)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}", lambda: f"0{d(1)} {d(2)}", lambda: f"00{d(2)} {d(2)}", lambda: f"0{d(1)}/{d(2)}/{d(2)}"],
            (4, True): [lambda: p(hexa, length()), lambda: p(hexa.upper(), length()), lambda: p(b64, int(r.integers(20, 48))), lambda: p(b64[:52], int(r.integers(24, 48))), lambda: "AKIA" + p(upper + "0123456789", 16), lambda: "sk_live_" + p(b64, 24), lambda: "ghp_" + p(b64, 36), lambda: p(b64 + "/+", 40), lambda: p(hexa, int(r.choice([128, 512, 1280])))],
            (4, False): [
                lambda: p(hexa, length()), lambda: f"{p(hexa, 8)}-{p(hexa, 4)}-{p(hexa, 4)}-{p(hexa, 4)}-{p(hexa, 12)}", lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T{d(2)}-{d(2)}-{d(2)}-{d(6)}", lambda: f"v{d(1)}_{d(1)}_{d(1)}-{self.one('beta', 'rc', 'alpha')}-20{d(2)}0{d(1)}1{d(1)}-build{d(2)}", lambda: d(int(r.integers(16, 22))),
                lambda: (upper * 2)[(k := int(r.integers(0, 10))) : k + int(r.integers(17, 27))], lambda: (upper.lower() * 2)[(k := int(r.integers(0, 10))) : k + int(r.integers(17, 27))], lambda: "-".join(w() for _ in range(6)), lambda: w() * 6, lambda: "/".join(w() for _ in range(6)) + d(2), lambda: p(upper.lower(), int(r.integers(17, 40))), lambda: "_".join([w(), w(), w(), d(4)]),
                lambda: "-" * int(r.integers(16, 40)), lambda: p(upper, int(r.integers(17, 30))), lambda: "".join(w().capitalize() for _ in range(7)), lambda: "/" + "/".join(w() for _ in range(6)), lambda: "_".join(w().upper() for _ in range(5)), lambda: f"{w()}-{w()}-{d(1)}-{d(2)}-{d(1)}-{w()}{d(2)}", lambda: "".join(w() for _ in range(8)).capitalize(), lambda: f"sha256-{p(hexa, 64)}", lambda: "0123456789abcdef"[: int(r.integers(10, 17))] * 2,
            ],
        }

    #: Kinds and forms that only their context tells from personal ones, and so always have one.
    NEED = {(4, True): (0, 1, 3, 8)}

    def example(self, kind: int, good: bool, form: int, make) -> tuple:
        r = self.rng
        ahead, against = ([x.decode() for x in of[kind]] for of in (_WORDS, _AGAINST))
        need = form in self.NEED.get((kind, good), ())
        # For what is personal a word that says so, in half of the cases; for what isn't, one that says that.
        cue = self.one(*ahead) if good and (need or r.random() < 0.5) else self.one(*against) if not good and r.random() < 0.4 else self.one(*ahead) if not good and kind in (1, 2, 3) and r.random() < 0.06 else None
        sign = self.one(": ", " = ", ' = "', " ", '="', " is ")
        before = f"{self.word()} {self.word()} " + (f"{cue}{sign}" if cue else f"{self.word()} ")
        after = ('"' if cue and sign.endswith('"') else "") + self.one(" ", ", ", ". ") + self.word()
        span = str(make())
        return kind, span.encode(), before.encode()[-AHEAD:], after.encode()[:BEHIND], good


#: Parts of the forms; thresholds are set on the forms of each part by trees of the others.
FOLDS = 4


def _examples(rng: np.random.Generator, n: int, fold: int | None = None):
    """(kind, span, before, after, label) of invented spans, half of them personal; fold: only
    forms of that part."""
    made = _Forms(rng)
    forms = made.forms()
    for _ in range(n):
        kind, good = int(rng.integers(len(KINDS))), bool(rng.random() < 0.5)
        count = len(forms[kind, good])
        ways = [f for f in range(count) if fold is None or f % min(FOLDS, count) == fold % min(FOLDS, count)]
        form = int(rng.choice(ways))
        yield made.example(kind, good, form, forms[kind, good][form])


@cache
def model(seed: int = 11, n: int = 4000) -> tuple[Boosted, tuple[float, ...]]:
    """The boosted trees, and for each kind the least score of a span that is taken.

    Trained on invented spans with their contexts. A threshold is the smallest at which at most
    WRONG of the taken are wrong, where each form is scored by trees that have not seen it.
    """

    def data(fold):
        rows = list(_examples(np.random.default_rng([seed, fold]), n // FOLDS, fold))
        return np.array([describe(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float), np.array([r[0] for r in rows])

    folds = [data(f) for f in range(FOLDS)]
    join = lambda parts: [np.concatenate(c) for c in zip(*parts, strict=True)]
    scored = []
    for f, (x, y, kind) in enumerate(folds):
        seen = join([d for g, d in enumerate(folds) if g != f])
        scored.append((Boosted().fit(*seen[:2]).predict(x), y, kind))
    p, t, kind = join(scored)
    limits = []
    for k in range(len(KINDS)):
        order = np.argsort(-p[kind == k], kind="stable")
        q, good = p[kind == k][order], t[kind == k][order]
        ok = np.flatnonzero(np.cumsum(1 - good) <= WRONG * np.arange(1, len(good) + 1))
        limits.append(float(q[ok[-1]]) if len(ok) else 1.1)
    return Boosted().fit(*join(folds)[:2]), tuple(limits)


def find_many(texts: list[bytes], trees: Boosted, limits) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, (kind, start, end) in bytes.

    Base spans stay. A candidate is added if its score reaches its kind's threshold and it meets
    no base span and no candidate that scores higher; of equal scores the one that is proposed
    first, by kind and then by place, counts as higher. All texts' candidates are scored at once.
    """
    found, every, features = [], [], []
    for text in texts:
        base = base_spans(text) if text else []
        proposed = candidates(text) if text else []
        taken = _merged(base) if proposed else []
        free = [c for c in dict.fromkeys(proposed) if not _meets(taken, c[1], c[2])]
        features += [describe(k, text[lo:hi], text[max(0, lo - AHEAD) : lo], text[hi : hi + BEHIND]) for k, lo, hi in free]
        found.append((base, taken, free))
    p = trees.predict(np.array(features)) if features else np.zeros(0)
    at = 0
    for base, taken, free in found:
        score, added = p[at : at + len(free)], []
        at += len(free)
        for i in np.argsort(-score, kind="stable"):
            k, lo, hi = free[i]
            if score[i] < limits[k]:
                continue
            if not _meets(taken, lo, hi):
                added.append((k, lo, hi))
                bisect.insort(taken, (lo, hi))
        every.append((base, base + added))
    return every


def find_spans(text: bytes, trees: Boosted, limits) -> tuple[list, list]:
    return find_many([text], trees, limits)[0]


def _merged(spans) -> list[tuple[int, int]]:
    """The disjoint intervals that the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((a, b) for _, a, b in spans):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _meets(taken, lo: int, hi: int) -> bool:
    """Whether (lo, hi) overlaps one of the disjoint, sorted intervals."""
    i = bisect.bisect_left(taken, (hi, hi))
    return i > 0 and taken[i - 1][1] > lo


def _points(text: bytes, spans):
    """Spans in code points, in order of kind and start."""
    ends = sorted({x for _, a, b in spans for x in (a, b)})
    at, last, n = {}, 0, 0
    for e in ends:
        n += len(text[last:e].decode("utf-8", "replace"))
        at[e], last = n, e
    return sorted((k, at[a], at[b]) for k, a, b in spans)


def _by_runs(texts, trees, limits, size: int = 1 << 20):
    """(text, base spans, all spans), by runs of texts of about `size` bytes."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= size:
            yield from ((t, *f) for t, f in zip(run, find_many(run, trees, limits), strict=True))
            run, held = [], 0
    yield from ((t, *f) for t, f in zip(run, find_many(run, trees, limits), strict=True))


def _finder(trees, limits):
    def run(batches):
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column(1)
            out = {"n": [], "base": [], "spans": [], "kinds": []}
            raws = (texts[i].as_buffer().to_pybytes() for i in range(len(texts)))
            for text, base, every in _by_runs(raws, trees, limits):
                if every:
                    base, every = _points(text, base), _points(text, every)
                out["n"].append([*(sum(k == j for k, _, _ in base) for j in range(4)), sum(k == 4 for k, _, _ in every), len(every)])
                out["base"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest() if base else empty)
                out["spans"].append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in every))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n"], pa.list_(pa.int64())), pa.array(out["base"], pa.string()), pa.array(out["spans"], pa.string())], ["id", "n", "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans of each row of docs.

    The first four counts and the digest are of base spans, in code points with exclusive ends;
    spans has the added ones too, joined in the same way, n_secret counts those of secrets, n_spans
    all of them. Candidates and spans have no greatest
    length. A null text is an empty one; null and repeated ids give a row each; other columns
    don't matter.
    """
    trees, limits = model()
    # A blob for the bytes as they are; the text can't be split between rows.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs).cast("binary").alias("text"))
    found = rows.mapInArrow(_finder(trees, limits), "id bigint, n array<bigint>, base_sha256 string, spans string")
    return found.select(F.col("id").alias(id_col), *[F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)], "base_sha256", "spans", F.col("n")[4].alias("n_secret"), F.col("n")[5].alias("n_spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with each found span replaced by its kind in angle brackets; null texts stay."""
    trees, limits = model()
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            new = []
            for text in batch.column(at).to_pylist():
                raw = text.encode() if text else b""
                for k, a, b in sorted(find_spans(raw, trees, limits)[1], key=lambda s: -s[1]) if raw else ():
                    raw = raw[:a] + f"<{KINDS[k]}>".encode() + raw[b:]
                new.append(text if not text else raw.decode("utf-8", "replace"))
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
