"""Personal data by base patterns and a linear-chain conditional random field over word shapes.

The base patterns always count. The field, trained from the small labelled table below, adds spans
that the patterns miss (numbers without a plus, addresses without a dot, identity numbers, cards that
stand side by side). A sequence of the field is a sentence of the text. Every sentence is decoded whole but
for those without a digit and an at sign: spans without either are never added (``_plausible``), so
leaving them out changes nothing. Added spans that touch a base span are dropped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_arrow, table
from .crf import Crf, Types, train

KINDS = ("email", "ip", "card", "phone", "id")
BASE_KINDS = KINDS[:4]
SPANS = "array<struct<kind: string, start: int, end: int>>"
BUCKETS = 1 << 12
#: A sentence of more tokens goes on as a new sequence at its next word.
SENTENCE = 1024
_END = re.compile(r"\n+|(?<=[.!?])\s+(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The labelled table: one text a line, spans in double brackets with their kind. Numbers are only shapes to learn from.
LABELLED = """
Write to [[email:anna.berg@example.com]] before noon.
Contact: [[email:support@mail.example.org]], room 12.
His address is [[email:j_doe99@uni.example.edu]] and he has 3 dogs.
Send it to [[email:sales-team@shop.example.net]].
ask [[email:kim@lab]] about it
mail [[email:lee+news@corp.example.co.uk]] now
note to [[email:ben@desk]] please
cc [[email:ops@hub]] and wait
tell [[email:mary@localhost]] today
und [[email:x@y.de]] schreiben
The server at [[ip:10.0.0.1]] is down.
Blocked [[ip:192.168.44.12]] and [[ip:203.0.113.9]] today
ping [[ip:8.8.8.8]]: 20 ms
host [[ip:172.16.254.3]] port 8080
Paid with [[card:4111 1111 1111 1111]] yesterday.
card [[card:5500000000000004]] was declined
la tarjeta [[card:4012-8888-8888-1881]] de
carte [[card:6011000990139424]] expire
nummer [[card:3714 496353 98431]] heute
both [[card:5500000000000004]] [[card:4111111111111111]] were used
paid by [[card:4222222222222222]] [[card:4222222222222222]] twice
number [[card:4222222222222222]] on file
Call [[phone:+1 (212) 555-0187]] after five.
Ring [[phone:+44 20 7946 0958]] or [[phone:+49 30 901820]].
phone [[phone:(415) 555-0132]] for details
tel. [[phone:415-555-0199]] heute
call [[phone:212.555.0143]] now
mobile [[phone:07700 900123]] please
appelez [[phone:01 42 68 53 00]] demain
ruf [[phone:0171 5550123]] an
Fax [[phone:(030) 555 01 77]], Zimmer 4
Praxis: [[phone:0341 555 20 11]], Hof
Verein [[phone:0711 555 64 02]], montags
SSN [[id:078-05-1120]] on the form
social security [[id:219-09-9999]] was given
id [[id:536-22-1234]] is hers
The year 1998 was warm and 2004 was not.
In 1999, 12 people met in room 7.
It costs 15 dollars, or 1,200 in all.
Chapter 3, page 210, line 14.
Version 2.0 came after 1.4.2 in May.
About 45 percent of 3000 homes
At 10:30 he ran 5.5 miles in 40 minutes.
They sold 1200 of 4500 tickets.
On 2021-04-23 the 4th report came.
see 12/05/2019 and 3 others
El 25 de mayo hay 300 casas.
Am 3. Mai 2020 kamen 17 Leute.
Le 14 juillet 1789 et 2 fois
pi is 3.14159 and e 2.71828
up 3-2 at half time, 98-95 at the end
track 7 of 9, 1080p at 60 fps
hash 9f86d081884c7d659a2feaa0c55ad015 matches
token = "04dbebab91ab85687d33eeaaf9ac699e" here
meet me @ noon, @ the 2nd gate
order 66 of 100 @ 5 each
GNU License, version 3 of 2007
"""


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, at sign and dotted domain, leftmost first, in one pass over the at signs."""
    found, least, at = [], 0, text.find("@")
    while at >= 0:
        local = text[least:at]
        start = least + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        least = m.end() if m else at + 1
        at = text.find("@", least)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by start and then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _TRIGGER.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m.group()) if m.end() - m.start() <= 37 else ""  # 19 digits with a separator between any two
            if 12 <= len(d) <= 19 and _luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _shape(token: str) -> str:
    """Runs of digits with their length, other characters by class; punctuation as it is."""
    if not token or not (token[0].isalnum()):
        return token
    if token.isascii() and token.isdigit():
        return f"d{len(token) if len(token) < 12 else '12+'}"
    return re.sub(r"(.)\1+", r"\1+", "".join("9" if c.isdigit() else "X" if c.isupper() else "x" for c in token))


#: Words near a number that tell its kind; other words are known by shape alone.
_CUES = {"ssn", "social", "security", "id", "tel", "phone", "call", "ring", "fax", "mobile", "ruf", "appelez", "card", "carte", "tarjeta", "year", "version"}


@cache
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def _features(token: str) -> list[int]:
    shape, low = _shape(token), token.lower()
    digits = sum(c.isdigit() for c in token)
    cls = "d" if digits == len(token) and token else "m" if digits else "w" if token[:1].isalpha() else "p"
    return [_bucket("s" + shape), _bucket("c" + cls), _bucket("n" + (str(min(len(token), 13)) if cls == "d" else "")), _bucket("w" + (low if low in _CUES else "")), _bucket("b")]


#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)


def labelled_table() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) of ``LABELLED``."""
    out = []
    for line in LABELLED.strip().split("\n"):
        text, spans = "", []
        for part in re.split(r"(\[\[[a-z]+:[^\]]+\]\])", line):
            if part.startswith("[["):
                kind, _, value = part[2:-2].partition(":")
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += part
        out.append((text, spans))
    return out


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]] | None = None, seed: int = 3) -> Crf:
    """The field learned from (text, spans) rows; every row also counts with its digits changed, so that only shapes matter."""
    sequences, rng = [], np.random.default_rng(seed)
    for text, spans in rows or labelled_table():
        for again in range(3):
            t = text if not again else "".join(str(rng.integers(10)) if c.isascii() and c.isdigit() else c for c in text)
            places = list(_TOKEN.finditer(t))
            labels = [0] * len(places)
            for kind, a, b in spans:
                inside = [i for i, m in enumerate(places) if a <= m.start() and m.end() <= b]
                for i in inside:
                    labels[i] = 2 * KINDS.index(kind) + (1 if i == inside[0] else 2)
            sequences.append(([m.group() for m in places], labels))
    crf = train(Crf.zeros(BUCKETS, LABELS), Types(_features), sequences, epochs=60, batch=32, rate=0.3, decay=1e-4)
    for k in range(len(KINDS)):  # an inside label follows only labels of its own kind
        for j in range(LABELS):
            if j not in (2 * k + 1, 2 * k + 2):
                crf.trans[j, 2 * k + 2] = -50.0
        crf.start[2 * k + 2] = -50.0
    return crf


def _plausible(kind: str, s: str) -> bool:
    """What a span of the kind must hold besides its label; every kind needs a digit or an at sign."""
    n = len(_digits(s))
    return {"email": "@" in s and len(s) >= 5, "ip": n >= 4 and s.count(".") == 3, "card": 12 <= n <= 19 and _luhn(_digits(s)), "phone": 7 <= n <= 15, "id": n == 9}[kind]


def sentences(text: str, every: bool = False) -> Iterator[list[tuple[int, int]]]:
    """(start, end) of the tokens of each sentence with a digit or at sign, or of ``every`` one.

    A sentence ends at line breaks, and at space after a full stop, exclamation or question mark where a letter follows.
    """
    if not every and not _TRIGGER.search(text):
        return
    ends = [m.span() for m in _END.finditer(text)]
    for a, b in zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)], strict=True):
        if every or _TRIGGER.search(text, a, b):
            run: list[tuple[int, int]] = []
            for m in _TOKEN.finditer(text, a, b):
                if len(run) >= SENTENCE and m.group().isalpha():
                    yield run
                    run = []
                run.append(m.span())
            if run:
                yield run


def _covered(base: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that base spans cover, apart and in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in base:
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


class Tagger:
    """Base and added spans of texts, decoded in one numpy batch a call."""

    def __init__(self, crf: Crf, every: bool = False):
        self.crf, self.types, self.every = crf, Types(_features, most=50_000), every
        self.emit = np.zeros((0, 3, LABELS))

    def spans(self, texts: list[str | None]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        """(base spans, added spans) of each text."""
        if len(self.types.rows) > self.types.most:
            self.types.clear()
            self.emit = self.emit[:0]
        base = [base_spans(t or "") for t in texts]
        places, lengths, owner = [], [], []
        for i, t in enumerate(texts):
            for found in sentences(t, self.every) if t else ():
                places += found
                lengths.append(len(found))
                owner += [i] * len(found)
        added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if places:
            ids = np.array(self.types.ids([texts[i][a:b] for i, (a, b) in zip(owner, places, strict=True)]))
            if new := self.types.rows[len(self.emit) :]:
                self.emit = np.concatenate([self.emit, self.crf.of_types(np.array(new))])
            sizes = np.array(lengths)
            best = self.crf.best(self.crf.emissions(self.emit, ids, sizes), sizes)
            covered = [_covered(b) for b in base]
            for i, kind, a, b in self._runs(best, places, np.repeat(np.arange(len(sizes)), sizes), owner):
                starts, ends = covered[i]
                before = bisect_left(starts, b) - 1
                if _plausible(kind, texts[i][a:b]) and (before < 0 or ends[before] <= a):
                    added[i].append((kind, a, b))
        return list(zip(base, added, strict=True))

    @staticmethod
    def _runs(best: np.ndarray, places: list, sequence: np.ndarray, owner: list):
        """(text, kind, start, end) of each run of begin and inside labels of a sequence."""
        begins = np.flatnonzero(best % 2)
        for at in begins.tolist():
            kind, end = (best[at] - 1) // 2, at + 1
            while end < len(best) and best[end] == 2 * kind + 2 and sequence[end] == sequence[at]:
                end += 1
            yield owner[at], KINDS[kind], places[at][0], places[end - 1][1]


def find_personal_data(docs: DataFrame, crf: Crf | None = None, keep_text: bool = False) -> DataFrame:
    """(doc_id, base, added[, redacted]) for every row; spans in code points, end exclusive.

    Null texts are empty; ``redacted`` is null for them, else the text with each stretch of spans replaced by the first span's kind
    in brackets. Repeated rows come back each, null ids stay, other columns are ignored, an empty table gives no rows. Base
    spans of different kinds may overlap; added ones overlap none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf or fit())

    def make():
        tagger = Tagger(shared.value)

        def work(cols: dict) -> dict:
            found = tagger.spans(cols["text"])
            rows = lambda i: [[{"kind": k, "start": a, "end": b} for k, a, b in x[i]] for x in found]
            out = {"doc_id": cols["doc_id"], "base": rows(0), "added": rows(1)}
            return out | ({"redacted": [redact(t, b + a) for t, (b, a) in zip(cols["text"], found, strict=True)]} if keep_text else {})

        return work

    schema = f"doc_id long, base {SPANS}, added {SPANS}" + ", redacted string" * keep_text
    return map_arrow(docs.select("doc_id", "text"), make, schema)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans count as one."""
    if text is None or not spans:
        return text
    whole: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if whole and a < whole[-1][2]:
            whole[-1][2] = max(b, whole[-1][2])
        else:
            whole.append([kind, a, b])
    gaps = [text[x[2] : y[1]] for x, y in pairwise(whole)] + [text[whole[-1][2] :]]
    return text[: whole[0][1]] + "".join(f"[{k}]{g}" for (k, _, _), g in zip(whole, gaps, strict=True))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, the hash of their list, and the list of all spans."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    ranks = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), ranks[s["kind"]].alias("o"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(keyed)).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(table(spark, sf_dir, "documents")))
