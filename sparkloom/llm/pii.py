"""Personal data: base patterns over the whole text, and a semi-Markov conditional random field for what they miss.

The CRF scores whole segments of tokens. Only stretches near a digit or an at-sign (islands, cut at line ends) can hold
a segment that isn't plain text, so the dynamic program runs on islands; elsewhere its result is plain text for certain.
Within an island it chooses boundaries and types together: best[j] = max over segment lengths (1 for plain text, up to
MAX_TOKENS for an entity) and types of best[i] + score(i, j, type). The weights are fitted by maximising the conditional
log-likelihood (semi-Markov forward-backward) on islands of at most SAMPLE documents, labelled by the base patterns, and
on rewritten copies: entities in other notations, and near-misses (a broken check digit, a wrong count of digits) as
plain text. A predicted entity that overlaps no base span is added if it beats plain text by MARGIN in log-odds.

Defined results: null counts as an empty text; base spans always stay; without a sample (an empty table, no personal
data in it) nothing is added. Spans are ordered by start, kind, end. Repeated rows each get a row.
"""

from __future__ import annotations


import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, fresh
from sparkloom.llm.secrets import SPANS, SPANS_SQL, digest

KINDS = ("email", "ip", "card", "phone")
PLAIN = "plain"
MAX_TOKENS, CONTEXT, MARGIN = 24, 40, 0.75
#: Documents to fit on, islands to fit on, rounds, step.
SAMPLE, ISLANDS, ROUNDS, STEP = 200, 1_200, 8, 0.3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits with at most one mark between two of them; no address and no card number crosses its ends.
_ZONE = re.compile(r"[0-9](?:[\x20.-]?[0-9])*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\S\n]+|\S")
#: An at-sign, or the word in brackets, or the bare word before a host and a spelt-out dot.
_AT = re.compile(r"@|[\[(] ?at ?[\])]|(?<=[A-Za-z0-9]) at (?!(?:the|an?|this|that|these|those|our|my|his|her|its|their|your|one|each|every|any|which|what|all|no) )(?=[A-Za-z0-9-]+ dot [A-Za-z])")
_DOT = r"(?:\.| ?[(\[] ?dot ?[)\]] ?| dot )"
_ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]+(?:@| ?[\[(] ?at ?[\])] ?| at )(?:[A-Za-z0-9-]+{_DOT})+[A-Za-z]{{2,10}}")
_MORE = re.compile(rf"{_DOT}[A-Za-z0-9]")
#: Words that announce personal data; other words before a segment don't count.
CUES = {"call", "phone", "tel", "telephone", "fax", "mail", "email", "contact", "write", "reach", "card", "visa", "account", "ip", "host", "server", "address", "number", "version", "page", "dated", "order"}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d // 5 + d * 2 % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """A match starts at the first local character before its at-sign that no earlier match took; local parts hold no at-sign, so one pass finds all."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at) if at >= free else None
        if m:
            start = at
            while start > free and _LOCAL.match(text, start - 1, start):
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return out


def zones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ZONE.finditer(text)]


def _phones(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m:
            out.append(m.span())
        at = text.find("+", m.end() if m else at + 1)
    return out


def scan(text: str, digits: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """The base spans of one text: leftmost non-overlapping matches of each kind, failing ones dropped without another try. digits: its zones."""
    found = [("email", *s) for s in _emails(text)]
    for a, b in zones(text) if digits is None else digits:
        if b - a >= 7:
            found += [("ip", *m.span()) for m in _IP.finditer(text, a, b) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        if b - a >= 12:
            found += [("card", *m.span()) for m in _CARD.finditer(text, a, b) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", a, b) for a, b in _phones(text) if 9 <= len(_digits(text[a:b])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def islands(text: str, digits: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Stretches within CONTEXT of a digit or an at-sign, cut at line ends; overlapping ones are one."""
    marks = zones(text) if digits is None else digits
    if "@" in text or "at]" in text or "at)" in text or "at ]" in text or "at )" in text or " dot " in text:
        marks = sorted([*marks, *(m.span() for m in _AT.finditer(text))])
    out: list[list[int]] = []
    for a, b in marks:
        lo, hi = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
        cut = text.rfind("\n", lo, a)
        lo = cut + 1 if cut >= 0 else lo
        cut = text.find("\n", b, hi)
        hi = cut if cut >= 0 else hi
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def features(text: str, start: int, end: int, before: str) -> list[str]:
    """What a whole segment looks like; before is the last word ahead of it. Names, hosts and digits themselves don't count."""
    s = text[start:end]
    left, right, cue = text[start - 1 : start], text[end : end + 1], before.lower() if before.lower() in CUES else ""
    joined = left in ".-+@_" and left != "" or right in "-@_" and right != ""
    at = _AT.search(s)
    if at:
        whole, more = bool(_ADDRESS.fullmatch(s)), bool(_MORE.match(text, end))
        out = [f"address={whole}", f"sign={'@' if '@' in at[0] else 'word' if at[0][0] == ' ' else 'mark'}", f"more={more}", f"open={left.isalnum() or right.isalnum()}", f"joined={joined}", f"blanks={min(6, s.count(' '))}", f"cue={cue}"]
        return [*out, out[0] + out[1], out[0] + out[2], out[0] + out[3], out[0] + out[4]]
    d = _digits(s)
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", s)))
    groups = re.findall(r"[0-9]+", s)
    out = [
        f"shape={shape[:24]}", f"digits={len(d)}", f"luhn={len(d) >= 12 and luhn(d)}", f"plus={s[:1] == '+'}", f"start={s[:1] in '+('}",
        f"quad={len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and s.count('.') == 3}",
        f"groups={'-'.join(str(min(len(g), 7)) for g in groups[:6])}", f"marks={''.join(sorted(set(re.sub(r'[A-Za-z0-9]', '', s))))[:8]}",
        f"letters={any(c.isalpha() for c in s)}", f"open={left.isalnum() or right.isalnum()}",
        f"joined={joined}", f"cue={cue}",
    ]
    return [*out, out[2] + out[1], out[3] + out[1], out[8] + out[6], out[6] + out[7], out[6] + out[7] + out[10] + out[9]]


class Island:
    """Tokens of a stretch and its candidate segments with their features."""

    def __init__(self, text: str, lo: int, hi: int):
        self.tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        self.candidates: dict[tuple[int, int], list[str]] = {}
        # A number starts with a digit, plus or bracket, ends with a digit and has no letters; anything else has an at-sign, and starts and ends with a letter or digit.
        n, word, before = len(self.tokens), "", []
        signs = [m.span() for m in _AT.finditer(text, lo, hi)]
        for a, b in self.tokens:
            before.append(word)
            if text[a].isalpha():
                word = text[a:b]
        for i, (a, _) in enumerate(self.tokens):
            number = text[a] in "+(" or "0" <= text[a] <= "9"
            if not number and not (signs and text[a].isalpha()):
                continue
            letters = False
            for j in range(i, min(n, i + MAX_TOKENS)):
                b = self.tokens[j][1]
                last = text[b - 1]
                letters = letters or last.isalpha()
                if b - a >= 6 and (number and not letters and "0" <= last <= "9" or last.isalnum() and any(a < s and e < b for s, e in signs)):
                    self.candidates[i, j + 1] = features(text, a, b, before[i])

    def scores(self, weights: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
        zero = np.zeros(len(KINDS))
        return {k: sum((weights[f] for f in fs if f in weights), zero) for k, fs in self.candidates.items()}

    def best(self, weights: dict[str, np.ndarray]) -> list[tuple[str, int, int, float]]:
        """The best labelling's entities with their scores; a plain token scores 0."""
        n, got = len(self.tokens), self.scores(weights)
        ends = defaultdict(list)
        for (i, j), s in got.items():
            if s.max() > 0:
                ends[j].append((i, int(s.argmax()), float(s.max())))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, k, s in ends[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k, s)
        out, j = [], n
        while j > 0:
            if back[j]:
                i, k, s = back[j]
                out.append((KINDS[k], self.tokens[i][0], self.tokens[j - 1][1], s))
                j = i
            else:
                j -= 1
        return out[::-1]

    def gradient(self, weights: dict[str, np.ndarray], gold: set[tuple[str, int, int]]) -> dict[tuple[int, int], np.ndarray]:
        """Of the log-likelihood, by candidate: the gold segments less their expectation (forward-backward)."""
        n, got = len(self.tokens), self.scores(weights)
        up, down = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        up[0] = down[n] = 0.0
        ends, starts = defaultdict(list), defaultdict(list)
        for (i, j), s in got.items():
            total = float(np.logaddexp.reduce(s))
            ends[j].append((i, total))
            starts[i].append((j, total))
        for j in range(1, n + 1):
            up[j] = np.logaddexp.reduce([up[j - 1], *(up[i] + s for i, s in ends[j])])
        for i in range(n - 1, -1, -1):
            down[i] = np.logaddexp.reduce([down[i + 1], *(down[j] + s for j, s in starts[i])])
        out = {}
        for (i, j), s in got.items():
            g = -np.exp(np.minimum(up[i] + s + down[j] - up[n], 0.0))
            for k, kind in enumerate(KINDS):
                if (kind, self.tokens[i][0], self.tokens[j - 1][1]) in gold:
                    g[k] += 1
            out[i, j] = g
        return out


def _luhn_break(s: str, rng: random.Random) -> str:
    at = rng.choice([i for i, c in enumerate(s) if c.isdigit()])
    return s[:at] + str((int(s[at]) + rng.randrange(1, 9)) % 10) + s[at + 1 :]


def _rewritten(kind: str, s: str, rng: random.Random) -> list[tuple[str, str]]:
    """Copies of an entity in other notations, and near-misses."""
    d = _digits(s)
    if kind == "email":
        user, _, domain = s.partition("@")
        word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(2, 9)))
        names = [(user, domain), (rng.choice([f"{word()}.{word()}", word(), f"{word()}{rng.randrange(100)}", f"{word()}_{word()}"]), ".".join([word(), *([word()] * rng.randrange(2)), rng.choice(["com", "org", "net", "de", "info"])]))]
        out = [(PLAIN, f"{user} @ "), (PLAIN, f"@{user}"), (PLAIN, f"{word()} (at) {word()} {word()}")]
        for u, h in names:
            out += [(kind, f"{u} [at] {h.replace('.', ' [dot] ')}"), (kind, f"{u} (at) {h}"), (kind, f"{u}(at){h.replace('.', '(dot)')}"), (kind, f"{u}[at]{h}"), (kind, f"{u} at {h.replace('.', ' dot ')}")]
        return out
    if kind == "ip":
        return [(PLAIN, s.replace(s.split(".")[0], str(rng.randrange(256, 999)), 1)), (PLAIN, ".".join(s.split(".")[:3])), (PLAIN, s.split(".")[0])]
    if kind == "card":
        cuts = [d[i : i + 4] for i in range(0, len(d), 4)]
        return [(kind, ".".join(cuts)), (kind, "/".join(cuts)), (PLAIN, _luhn_break(s, rng)), (PLAIN, d[:8]), (PLAIN, d[:4])]
    ten = d[-10:].rjust(10, "2")
    bad = d[:6]
    a, b, c = ten[:3], ten[3:6], ten[6:]
    out = [(kind, x) for x in (f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")]
    return out + [(PLAIN, x) for x in (bad, f"{bad[:4]}-{bad[4:]}-01", f"{bad[:4]}-{bad[:4]}", f"{c}.{a[:2]}.{b[:2]}", f"{a} {b} {bad[:3]}", f"{a[:2]} {b} {bad[:3]}", f"{a[0]}.{b[0]}.{c[:2]}", f"{a}.{b}.{bad[:3]}", f"{a},{b} {c}", f"{a},{b} ({c}", f"{a[0]},{b},{bad[:3]} {c}")]


def fit(texts: list[str], seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by feature, a value for each of KINDS. texts: the bounded sample."""
    rng, data = random.Random(seed), []
    for text in texts:
        gold = scan(text)
        for lo, hi in islands(text):
            # a base card inside a base phone and the like: the longest span stands for both
            inside = [g for g in gold if lo <= g[1] and g[2] <= hi]
            inside = [g for g in inside if not any(o != g and o[1] <= g[1] and g[2] <= o[2] for o in inside)]
            data.append((text[lo:hi], {(k, a - lo, b - lo) for k, a, b in inside}))
            for kind, a, b in inside:
                # What stands around it keeps its labels; what the ends of the copy would cut stays out.
                near = [g for g in inside if g[2] <= a or g[1] >= b]
                first = max([max(lo, a - CONTEXT), *(e for _, s, e in near if s < a - CONTEXT < e)])
                last = min([min(hi, b + CONTEXT), *(s for _, s, e in near if s < b + CONTEXT < e)])
                for other, new in _rewritten(kind, text[a:b], rng):
                    more = len(new) - (b - a)
                    gold_near = {(k, s - first, e - first) for k, s, e in near if first <= s and e <= a} | {(k, s - first + more, e - first + more) for k, s, e in near if b <= s and e <= last}
                    own = {(other, a - first, a - first + len(new))} if other != PLAIN else set()
                    data.append((text[first:a] + new + text[b:last], own | gold_near))
    rng.shuffle(data)
    weights: dict[str, np.ndarray] = {}
    prepared = [(Island(t, 0, len(t)), gold) for t, gold in data[:ISLANDS]]
    for turn in range(ROUNDS):
        for island, gold in prepared:
            for k, g in island.gradient(weights, gold).items():
                if np.abs(g).max() > 1e-3:
                    for f in island.candidates[k]:
                        w = weights.get(f)
                        weights[f] = STEP / (1 + turn) * g if w is None else w + STEP / (1 + turn) * g
    return {f: w for f, w in weights.items() if np.abs(w).max() > 1e-3}


def spans_of(text: str, weights: dict[str, np.ndarray]) -> list[dict]:
    """All spans of a document; base ones with an empty layer."""
    digits = zones(text)
    base = scan(text, digits)
    found = {s: "" for s in base}
    for lo, hi in islands(text, digits) if weights else []:
        for kind, a, b, score in Island(text, lo, hi).best(weights):
            if score >= MARGIN and not any(a < e and s < b for _, s, e in base):
                found[kind, a, b] = "crf"
    ordered = sorted(found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
    return [{"kind": k, "start": a, "end": b, "layer": how} for (k, a, b), how in ordered]


def sampled_weights(docs: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """Weights fitted on at most SAMPLE texts that have a digit or an at-sign, those of least hash (of each, the first 20,000 code points)."""
    hashed = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    picked = hashed.filter(F.col("t").rlike(r"@|[0-9]{3}")).groupBy("h").agg(F.count("*")).orderBy("h").limit(SAMPLE).select("h").collect()
    texts = hashed.filter(F.col("h").isin([r["h"] for r in picked])).groupBy("h").agg(F.first(F.substring("t", 1, 20_000)).alias("t"))
    return fit([r["t"] for r in sorted(texts.collect(), key=lambda r: r["h"])])


def with_pii(docs: DataFrame, text: str = "text", out: str = "pii", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """docs with a column out: {spans: [{kind, start, end, layer}], complete}. Code points, end exclusive. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    weights = sampled_weights(docs, text) if weights is None else weights

    def column(texts: pa.Array) -> pa.Array:
        return pa.array([{"spans": spans_of(t or "", weights), "complete": True} for t in texts.to_pylist()], type=SPANS)

    return docs.withColumn(out, F.arrow_udf(column, SPANS_SQL)(F.col(text)))


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest of every document's personal data."""
    own = docs.select("doc_id", "text")
    name = fresh(own, "pii")
    return digest(with_pii(own, out=name).select("doc_id", F.col(name)["spans"].alias("found")), "found", KINDS)
