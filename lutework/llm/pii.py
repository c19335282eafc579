"""Personal data by candidate spans and boosted trees with calibrated thresholds.

Four base kinds are patterns with a check: email, ip, card and phone. What they find stays. Beyond them, generators of high recall propose spans that may overlap, one
text often under several kinds: numbers in groups (as phone, card and ssn), addresses spelled out or with brackets ("jane at example dot org"), account
numbers, long strings of letters and digits (as secret), hardware and long network addresses. Gradient-boosted trees judge each
candidate by its format (groups, separators, checksums, entropy) and its context (words that announce its kind or another sort of number, neighbouring characters).
Isotonic regression on candidates that the trees haven't seen makes margins into probabilities, and each kind has the least threshold at which PRECISION of those
candidates are right. Of overlapping candidates that pass, the likeliest stays, and none that touches a base span.

Trees and calibration are fitted by Spark on SNIPPETS generated, labelled lines of text, once in a driver's life for a seed; the tasks get them as a few
small arrays and read each text once, where it is: nothing is shuffled.

Defined results: null and empty texts have no spans; rows with equal or null ids are texts each; offsets are code points, the end exclusive; an empty table gives
no rows; other columns are passed on. Patterns are written so that a text of any length costs its length: a search that fails doesn't begin again within what it has read.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, row_of

BASE, ADDED = ("email", "ip", "card", "phone"), ("ssn", "iban", "secret", "device")
KINDS = BASE + ADDED
#: Kinds that generators propose; ip is left to its pattern.
PROPOSED = ("email", "card", "phone", "ssn", "iban", "secret", "device")
#: Generated labelled lines that are learned from, code points of context before and after, and the share of right ones among what a threshold lets pass.
SNIPPETS, BEFORE, AFTER, PRECISION = 6000, 48, 12, 0.97

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, sought from each @ back and forth."""
    free, at = 0, text.find("@")
    while at >= 0:
        start, end = at, 0
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            end = free = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of what the base patterns find, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# Candidates

#: Numbers in groups: whole runs of them, digits and short separators by turns.
NUMBERS = re.compile(r"[(0-9](?:[ ().\-/]{0,2}+[0-9])++")
#: An at between words, in brackets or bare: what is sought, and what it must be part of.
AT, AROUND_AT = re.compile(r"(?:[aA][tT]|@)(?=[\s\])}>])"), re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s@\s|\sat\s", re.I)
#: All candidates but spelled-out addresses have a digit, and no more than so many code points before or after it.
DIGITS, REACH = re.compile("[0-9]+"), 220
HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\s?\.\s?)[A-Za-z0-9-]{1,63}){1,4}", re.I)
NAME = re.compile(r"[A-Za-z0-9_+-]{1,64}(?:(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\.)[A-Za-z0-9_+-]{1,64}){0,4}$", re.I)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,32}(?!\w)")
SECRET = re.compile(r"(?<![\w/+=.-])[A-Za-z0-9_/+=-]{16,200}(?![\w/+=-])")
DEVICE = re.compile(r"(?<![\w:.-])[0-9A-Fa-f]{1,4}(?:[:-][0-9A-Fa-f]{0,4}){5,7}(?![\w:-])")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data, as kind, start and end: many more than there are, and overlapping."""
    out, windows = [], []
    for m in DIGITS.finditer(text):
        if windows and m.start() - REACH <= windows[-1][1]:
            windows[-1][1] = m.end() + REACH
        else:
            windows.append([max(0, m.start() - REACH), m.end() + REACH])
    for w in windows:
        for m in NUMBERS.finditer(text, *w):
            n = sum(map(str.isdigit, m[0])) if m.end() - m.start() <= 40 else 0
            before = text[m.start() - 1 : m.start()]
            if n < 7 or before in (".", "+", "_") or before.isalnum():
                continue
            if n <= 15:
                out.append(("phone", *m.span()))
            if n >= 13 and n <= 19:
                out.append(("card", *m.span()))
            if n == 9:
                out.append(("ssn", *m.span()))
        out += [("iban", *m.span()) for m in IBAN.finditer(text, *w)]
        out += [("secret", *m.span()) for m in SECRET.finditer(text, *w) if any(map(str.isdigit, m[0])) and not m[0].isdigit()]
        out += [("device", *m.span()) for m in DEVICE.finditer(text, *w)]
    for x in AT.finditer(text):
        if x.start() and text[x.start() - 1] in " \t\n\r[({<" and (m := AROUND_AT.search(text, max(0, x.start() - 3), x.end() + 3)):
            head, tail = NAME.search(text[max(0, m.start() - 96) : m.start()]), HOST.match(text, m.end())
            if head and tail:
                out.append(("email", m.start() - len(head[0]), tail.end()))
    return out


# Words that announce a kind, by kind, and words that announce numbers of other sorts.
CUES = {
    "email": "mail email e-mail contact write reach correo kontakt adresse courriel schreib escribe",
    "card": "card credit visa mastercard amex payment pay karte kreditkarte carte tarjeta",
    "phone": "phone tel telephone call mobile cell fax sms whatsapp telefon handy anrufen telefono teléfono llamar téléphone appelez portable",
    "ssn": "ssn social security sin nss sozialversicherung taxpayer tin",
    "iban": "iban account bank konto transfer compte cuenta banco überweisung",
    "secret": "token key secret password passwd pwd api apikey auth bearer credential passwort clave contraseña",
    "device": "mac ipv6 device address hardware host ip gerät",
}
OTHER_NUMBERS = frozenset(
    "isbn issn order invoice page pages version no number item ref sku part model year years chapter figure table total price eur usd date issue volume "
    "bestellung rechnung seite commande facture página pedido tracking build commit sha hash checksum md5 id uuid serial vol lot doi line".split()
)
CUE_SETS = {k: frozenset(v.split()) for k, v in CUES.items()}
CONTEXT_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def valid_iban(text: str) -> bool:
    bare = text.replace(" ", "").upper()
    return bare.isalnum() and bare.isascii() and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Measures of a candidate's format and context."""
    span, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    digits = re.sub("[^0-9]", "", span)
    groups = re.findall("[0-9]+", span)
    separators = re.sub(r"\w", "", span)
    counts = Counter(span)
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in counts.values())
    heard = [w.lower() for w in CONTEXT_WORD.findall(before)]
    near = heard[-3:]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    return [
        *[float(kind == k) for k in PROPOSED],
        float(len(digits)),
        float(len(span)),
        float(sum(map(str.isalpha, span))),
        float(sum(map(str.isupper, span))),
        float(len(separators)),
        float(len(set(separators))),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(groups[-1]) if groups else 0),
        entropy,
        float(turns),
        float(len(set(digits))),
        float(kind == "card" and luhn(digits)),
        float(kind == "iban" and valid_iban(span)),
        float(kind == "ssn" and [len(x) for x in groups] == [3, 2, 4] and groups[0] not in ("000", "666") and separators in ("--", "  ")),
        float(span[:1] == "(" and ")" in span),
        float(span[:1] == "0"),
        float(bool(re.search(r"\bdot\b", span, re.I))),
        float("@" in span),
        float(span.count("[") + span.count("(")),
        float(re.fullmatch("[0-9a-fA-F]+", span) is not None),
        float(sum(w in CUE_SETS[kind] for w in near)),
        float(sum(w in CUE_SETS[kind] for w in heard)),
        float(any(w in OTHER_NUMBERS for w in near[-2:])),
        float(sum(w in OTHER_NUMBERS for w in heard)),
        float(sum(any(w in CUE_SETS[k] for w in near) for k in PROPOSED if k != kind)),
        float(before.rstrip(" \"'")[-1:] in (":", "=")),
        float(before[-1:] in ("$", "€", "£", "#", "%", "v")),
        float(after[:1] in ("%", "$", "€", "£", "°") or after[:3] in (" kg", " km", " eu", " us")),
        float(bool(re.search("[0-9][ .,]*$", before))),
        float(bool(re.match("[ .,]*[0-9]", after))),
    ]


# Generated labelled lines

SYLLABLES = "the an in ed er re on th and ing ou ble ly sh der ein ung keit sch lich pf mit la los que ción es ada le de ment eux ai ent par".split()


def generated(seed: int, n: int) -> list[tuple[str, str, int, int, int]]:
    """Candidates of n generated lines: text, kind, start, end and label, 1 for those that cover the personal datum that the line holds, as its kind."""
    r, out, plain = random.Random(seed), [], [x for x in SYLLABLES if x.isascii()]

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def grouped(s: str, sizes: tuple[int, ...], by: str) -> str:
        cut, at = [], 0
        for k in sizes:
            cut.append(s[at : at + k])
            at += k
        return by.join(cut)

    def word(of: list[str] = SYLLABLES) -> str:
        return "".join(r.choice(of) for _ in range(r.randint(1, 3)))

    def prose(k: int) -> str:
        return " ".join(word().capitalize() if r.random() < 0.15 else word() + r.choice(("", "", "", ",", ".")) for _ in range(k))

    def checked(k: int) -> str:
        s = r.choice("3456") + digits(k - 2)
        return next(s + c for c in "0123456789" if luhn(s + c))

    def phone() -> str:
        a, b, c = r.choice("23456789") + digits(2), digits(3), digits(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{r.choice('123456789')}{digits(2)} {digits(r.randint(5, 7))}", f"0{r.choice('1234567')} " + grouped(digits(8), (2, 2, 2, 2), " "), f"00{digits(2)} {digits(3)} {digits(6)}", f"9{digits(2)} {digits(3)} {digits(3)}"))

    def spelled() -> str:
        a, b = word(plain), word(plain)
        name, host = r.choice((a, f"{a} dot {b}", f"{a}.{b}", a + digits(2))), r.choice((word(plain), f"{b}-{a}"))
        at, dot = r.choice(((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", ".")))
        return name + at + host + dot + r.choice(("com", "org", "net", "de", "fr", "es"))

    def iban() -> str:
        country, bare = r.choice(("DE", "FR", "ES", "GB", "NL")), digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in bare + country + "00")) % 97
        s = f"{country}{check:02d}{bare}"
        return r.choice((s, " ".join(s[k : k + 4] for k in range(0, len(s), 4))))

    def secret() -> str:
        letters = r.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
        return r.choice(("", "", "sk_live_", "ghp_", "AKIA")) + "".join(r.choice(letters) for _ in range(r.choice((20, 24, 32, 40, 48)))) + "7"

    def device() -> str:
        return r.choice((":".join("".join(r.choice("0123456789abcdef") for _ in range(2)) for _ in range(6)), ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))))

    makers = {
        "phone": phone, "email": spelled, "iban": iban, "secret": secret, "device": device, "ssn": lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
        "card": lambda: r.choice((checked(15), grouped(checked(16), (4, 4, 4, 4), r.choice(("-", ".", "/"))), grouped(checked(15), (4, 6, 5), r.choice((" ", "-"))))),
    }

    def decoy() -> str:
        return r.choice((
            lambda: f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"order {digits(r.randint(7, 12))}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {digits(2)}",
            lambda: f"pages {digits(3)}-{digits(3)}, {digits(3)}", lambda: f"{r.randint(1900, 2030)}/{r.randint(1900, 2030)}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)} {r.choice(('eur', 'usd', 'km'))}",
            lambda: " ".join(digits(r.randint(1, 4)) for _ in range(r.randint(3, 6))), lambda: digits(r.randint(7, 19)), lambda: f"invoice {digits(4)}-{digits(5)}", lambda: f"version {digits(1)}.{digits(2)}.{digits(4)} {digits(4)}",
            lambda: f"{word()} at {word()} . {word().capitalize()}", lambda: f"{word()} at {word()}.{word().capitalize()}", lambda: "".join(word() for _ in range(6)) + r.choice(("", digits(1))), lambda: f"commit {''.join(r.choice('0123456789abcdef') for _ in range(40))}",
            lambda: f"/{word()}{word()}/{word()}-{word()}{digits(2)}/{word()}{word()}", lambda: "==" * r.randint(6, 12) + digits(2), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}{digits(1)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}",
            lambda: f"{r.choice(('AB', 'XK', 'TR'))}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"item {word()}-{digits(4)}-{word()}-{digits(6)}",
        ))()

    while len(out) < n:
        kind = r.choice((*makers, None, None, None, None))
        datum = makers[kind]() if kind else decoy()
        cue = ""
        if kind and (kind in ("secret", "ssn") or r.random() < 0.7):  # these two are nothing without their announcement
            cue = r.choice(sorted(CUE_SETS[kind])) + r.choice((" ", ": ", " = ", ' = "', "  "))
        elif not kind and r.random() < 0.08:
            cue = r.choice(sorted(OTHER_NUMBERS)) + " "
        if cue and r.random() < 0.3:
            cue = cue.capitalize()
        head = prose(r.randint(0, 9)) + " " + cue
        line = head + datum + r.choice((" ", '" ', ". ", "\n", ", ")) + prose(r.randint(0, 9))
        at = (len(head), len(head) + len(datum))
        for k, a, b in candidates(line):
            # a spelled-out address may have more to the left or right than its own words, as in running text
            right = k == kind and (k == "email" and a <= at[0] < at[1] <= b and at[0] - a <= 20 or abs(a - at[0]) <= 1 and abs(b - at[1]) <= 1)
            out.append((line, k, a, b, int(right)))
    return out[:n]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, apart from one another and in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def touches(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of taken, which are apart from one another and in order, has a place in common with a to b."""
    k = bisect_left(taken, (b,))
    return k > 0 and taken[k - 1][1] > a


@dataclass
class Judge:
    """Trees as arrays (one row a tree), and by kind the calibration's margins and probabilities, and the threshold."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    curves: dict[str, tuple[np.ndarray, np.ndarray]]
    thresholds: dict[str, float]

    def chance(self, rows: list[list[float]]) -> np.ndarray:
        """The probability that each candidate, as features, is personal data."""
        x, margin = np.array(rows), np.zeros(len(rows))
        for tree in range(len(self.feature)):
            at = np.zeros(len(rows), int)
            while (inner := self.feature[tree, at] >= 0).any():
                below = x[np.arange(len(rows)), np.maximum(self.feature[tree, at], 0)] <= self.cut[tree, at]
                at = np.where(inner, np.where(below, self.left[tree, at], self.right[tree, at]), at)
            margin += self.value[tree, at]
        kinds = x[:, : len(PROPOSED)].argmax(axis=1).tolist()
        return np.array([np.interp(m, *self.curves[PROPOSED[k]]) for k, m in zip(kinds, margin.tolist(), strict=True)])

    def spans(self, text: str) -> list[tuple[str, int, int, float, bool]]:
        """Kind, start, end, probability and whether it is a base one, of all spans by kind and start."""
        base = base_spans(text)
        kept = [(*x, 1.0, True) for x in base]
        taken = merged([(a, b) for _, a, b in base])
        found = [x for x in candidates(text) if not touches(taken, x[1], x[2])]
        if found:
            chances = self.chance([features(text, *x) for x in found])
            passed = sorted((-p, KINDS.index(k), a, b) for (k, a, b), p in zip(found, chances.tolist(), strict=True) if p >= self.thresholds[k])
            for p, k, a, b in passed:
                if not touches(taken, a, b):
                    insort(taken, (a, b))
                    kept.append((KINDS[k], a, b, -p, False))
        return sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1]))


def _arrays(trees: list, weights: list[float]) -> tuple[np.ndarray, ...]:
    """Spark's trees as arrays of equal width; leaves have feature -1 and their value times the tree's weight."""
    listed = []
    for tree, weight in zip(trees, weights, strict=True):
        nodes: list[list[float]] = []

        def add(node, weight: float = weight, nodes: list = nodes) -> int:
            at = len(nodes)
            if node.subtreeDepth() == 0:
                nodes.append([-1, 0.0, 0, 0, weight * node.prediction()])
                return at
            nodes.append([node.split().featureIndex(), node.split().threshold(), 0, 0, 0.0])
            nodes[at][2:4] = add(node.leftChild()), add(node.rightChild())
            return at

        add(tree._java_obj.rootNode())
        listed.append(nodes)
    width = max(map(len, listed))
    table = np.array([x + [[-1, 0.0, 0, 0, 0.0]] * (width - len(x)) for x in listed])
    return tuple(table[:, :, k].astype(t) for k, t in enumerate((int, float, int, int, float)))


@lru_cache(maxsize=4)
def _fitted(seed: int, n: int, precision: float) -> Judge:
    spark = SparkSession.getActiveSession()
    rows = [(features(t, k, a, b), float(label), i % 2, k) for i, (t, k, a, b, label) in enumerate(generated(seed, n))]
    frame = spark.createDataFrame(rows, "f array<double>, label double, half int, kind string").withColumn("v", array_to_vector("f")).coalesce(2)
    gbt = GBTClassifier(featuresCol="v", labelCol="label", maxDepth=5, maxIter=20, stepSize=0.2, seed=seed, maxBins=64, checkpointInterval=-1)
    model = gbt.fit(frame.where("half = 0"))
    scored = model.transform(frame.where("half = 1")).select("kind", "label", vector_to_array("rawPrediction")[1].alias("margin"))
    judged = scored.toPandas()  # half of n generated rows
    curves, thresholds = {}, {}
    for kind in PROPOSED:
        own = judged[judged["kind"] == kind]
        curve = IsotonicRegression(featuresCol="margin").fit(spark.createDataFrame(own[["margin", "label"]]).coalesce(1))
        curves[kind] = np.array(curve.boundaries.toArray()), np.array(curve.predictions.toArray())
        own = own.assign(p=np.interp(own["margin"], *curves[kind])).sort_values("p", ascending=False)
        right = own["label"].cumsum() / np.arange(1, len(own) + 1)
        fits = own["p"][(right >= precision) & (own["p"] > 0.5) & (own["p"] != own["p"].shift(-1))]
        thresholds[kind] = float(fits.min()) if len(fits) else math.inf
    return Judge(*_arrays(model.trees, model.treeWeights), curves, thresholds)


def judge(seed: int = 11, n: int = SNIPPETS, precision: float = PRECISION) -> Judge:
    """The fitted judge; the same one for the same parameters."""
    return _fitted(seed, n, precision)


def _applied(docs: DataFrame, by: Judge, masked: bool) -> DataFrame:
    """Of docs (text, row): row, spans and, if masked, the text with each span replaced by its kind in brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("chance", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            spans, texts = [], []
            for x in batch.column(0):
                text = x.as_py()
                own = by.spans(text) if text else []
                spans.append([dict(zip(("kind", "start", "stop", "chance", "base"), s, strict=True)) for s in own])
                texts.append(without(text, own) if masked else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(spans, kind_type), pa.array(texts, pa.string())], ["row", "spans", "redacted"])

    row = docs.schema["row"].dataType.simpleString()
    return in_small_batches(docs.select("text", "row")).mapInArrow(run, f"row {row}, spans array<struct<kind:string,start:bigint,stop:bigint,chance:double,base:boolean>>, redacted string")


def without(text: str | None, spans: list[tuple[str, int, int, float, bool]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping ones, the first to begin names them all."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out.append(f"{text[at:a]}[{kind}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def found(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text): doc_id and spans (kind, start, stop, chance, base)."""
    return _applied(docs.select("text", F.struct("doc_id").alias("row")), judge(), False).select("row.doc_id", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of their texts replaced by its kind in brackets."""
    rows = _applied(docs.select("text", row_of(docs)), judge(), True)
    return rows.select(*[F.col("redacted").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, numbers of base spans by kind, their digest, and all spans."""

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["base"])
    return found(docs).withColumn("base", base).select("doc_id", *map(n, BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
