"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

1. One pass over the whole texts finds the base spans (fixed rules; they always stay) and
   further candidates: secrets (long random tokens), digit strings, names (after a title, or a
   listed given name and a capitalised word) and spelled-out addresses.
2. Every candidate gets the votes (for, against, none) of regex, gazetteer and context
   labelers, and its shape: classes of length, digits, case, neighbouring characters and context words.
3. Expectation-maximisation over the counts of all candidates by (kind, votes), at most
   ``kinds * 3**labelers`` whatever the corpus, estimates how reliable each labeler
   is and the probability of each vote pattern (naive Bayes, one latent class per
   candidate, kinds with priors of their own).
4. A logistic classifier of spans is fitted to those probabilities over kind, votes, shape and kind with shape, so
   a span whose text or surroundings look like those of rejected ones goes in spite of its votes, and the reverse.
   It is fitted to the ``fit_patterns`` most frequent (kind, votes, shape), weighted by count, and scores every
   candidate.  Those it accepts are added, unless they overlap a base span.

Offsets are code points, end exclusive.  Cases: null text is empty; rows with equal or null
doc_ids are rows of their own; time is linear in a text's length (n log n in its spans); no candidate at all leaves only base spans; an empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameloom.llm.common import materialise

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "name", "secret", "spelled_email")
KINDS = BASE + ADDED

#: Gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com net org edu gov mil info biz io co dev app de fr es it nl uk eu us ca ch at be pl pt se no dk fi jp cn in br mx au nz example test".split())
NEAR = {
    "email": "email e-mail mail contact write reach courriel correo adresse address",
    "spelled_email": "email e-mail mail contact write reach courriel correo adresse address",
    "ip": "ip host server address client login adresse dirección from",
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile fax cell telefon téléphone teléfono",
    "account": "account iban ssn passport id konto compte cuenta customer member",
    "name": "name mr mrs ms dr dear regards signed von sincerely",
    "secret": "token secret password passwd key apikey auth bearer credential",
}
NEAR_WORDS = {k: frozenset(v.split()) for k, v in NEAR.items()}
AGAINST = frozenset("version license isbn issn doi chapter page section figure table rfc build release vol no".split())
GIVEN = frozenset("Adam Alan Alice Alison Amanda Amy Andrea Andrew Angela Anita Anna Anne Anthony Antonio Barbara Benjamin Bernard Bill Bob Brian Carl Carlos Carol Caroline Catherine Charles Charlotte Chris Christian Christine Christopher Claire Claudia Daniel David Deborah Dennis Diana Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Frank Fred Gary George Hans Helen Henry Ian Ines Irene Isabel Jack Jacob James Jane Janet Jason Jean Jennifer Jessica Jim Joan Joe Johann John Jonathan Jose Joseph Juan Judith Julia Julie Karen Karl Kate Katherine Kenneth Kevin Kim Klaus Larry Laura Linda Lisa Louis Lucas Lucy Luis Margaret Maria Marie Mark Martin Mary Matthew Michael Michelle Miguel Monica Nancy Nicholas Nicole Olga Oliver Oscar Pamela Patricia Patrick Paul Paula Pedro Peter Philip Rachel Ralph Rebecca Richard Robert Roger Ronald Rosa Ruth Samuel Sandra Sarah Scott Sharon Simon Sofia Sophie Stefan Stephen Steven Susan Thomas Timothy Tom Victor Victoria Walter Wendy William".split())
NOT_NAMES = frozenset("January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday President Minister Chairman Speaker Director Secretary Judge Justice Street Road Avenue University College School Church Hospital Airport Station River Lake Island Mountain County State City Company Corporation Inc Ltd Museum Park Bridge Hall House Award Prize Cup".split())
TITLES = r"Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Doña"

IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*[0-9])(?=[0-9_/+=-]*[A-Za-z])[A-Za-z0-9_/+=-]{20,}+(?![A-Za-z0-9_/+=-])")
SECRET_HINT = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]")
ACCOUNT = re.compile(r"(?<![0-9+.])[0-9]{9,19}(?![0-9])")
NAME = re.compile(rf"\b(?:{TITLES})\.? ([A-ZÀ-Þ][\w'-]++(?: [A-ZÀ-Þ][\w'-]++){{0,2}})")
GIVEN_NAME = re.compile(r"(?<![\w'-])([A-Z][a-z]++)(?: [A-Z]\.)?(?: [A-ZÀ-Þ][\w'-]++){1,2}")
TITLED = re.compile(rf"\b(?:{TITLES})\.? \Z")
SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+ ?[\[(]?(?:[Aa][Tt]|@)[\])]? ?[A-Za-z0-9-]{2,}+ ?[\[(]?(?:[Dd][Oo][Tt])[\])]? ?[A-Za-z]{2,}+\b")
SPELLED_HINT = re.compile("[Dd][Oo][Tt]")
HEX = re.compile(r"[0-9a-fA-F]+\Z")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of the fixed e-mail rule, found from each ``@`` in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed rules, by kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def added_candidates(text: str) -> list[tuple[str, int, int]]:
    out = [("account", m.start(), m.end()) for m in ACCOUNT.finditer(text)]
    titled = [m.span(1) for m in NAME.finditer(text)] if any(t in text for t in TITLES.split("|")) else []
    given = [m.span() for m in GIVEN_NAME.finditer(text) if m.group(1) in GIVEN]
    out += [("name", *x) for x in titled] + [("name", *x) for x in apart(given, titled)]
    if SECRET_HINT.search(text):
        out += [("secret", m.start(), m.end()) for m in SECRET.finditer(text)]
    if SPELLED_HINT.search(text):
        out += [("spelled_email", m.start(), m.end()) for m in SPELLED.finditer(text)]
    return out


def apart(spans: list, taken: list) -> list:
    """The ``spans`` (..., start, end) that overlap none of ``taken`` (..., start, end)."""
    merged: list[list[int]] = []
    for a, b in sorted(x[-2:] for x in taken):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    out = []
    for x in spans:
        i = bisect_left(starts, x[-1]) - 1  # the last one that starts before this span ends
        if i < 0 or merged[i][1] <= x[-2]:
            out.append(x)
    return out


def _variety(s: str) -> float:
    """Entropy of the characters in bits."""
    counts = [s.count(c) for c in set(s)]
    return -sum(n / len(s) * math.log2(n / len(s)) for n in counts)


def _form(kind: str, s: str) -> int:
    """Regex labeler: a strict form of the kind."""
    if kind in ("email", "spelled_email"):
        return 1 if re.search(r"\.[A-Za-z]{2,}\Z", s) or kind == "spelled_email" else -1
    if kind == "ip":
        return -1 if re.search(r"(^|\.)0[0-9]", s) else 1
    if kind == "phone":
        return 1 if re.search(r"[ ().-]", s) else 0
    if kind == "secret":
        return 1 if HEX.match(s) and len(s) in (32, 40, 64) else 0 if re.search("[A-Z]", s) and re.search("[a-z]", s) else -1
    if kind == "account":
        return -1 if len(set(s)) <= 2 else 0
    if kind == "name":
        return -1 if any(len(w) > 1 and w.isupper() for w in s.split()) else 0
    return 1


def _check(kind: str, s: str) -> int:
    """Checksum or range labeler."""
    digits = re.sub("[^0-9]", "", s)
    if kind in ("card", "account"):
        return 1 if luhn(digits) and len(digits) >= 13 else -1
    if kind == "ip":
        return -1 if s.split(".")[0] in ("0", "127", "255") else 1
    if kind == "phone":
        return 1 if 10 <= len(digits) <= 13 else -1
    return 0


def _listed(kind: str, s: str, before: str) -> int:
    """Gazetteer labeler: top domains, issuers, country codes, name particles, key words."""
    if kind in ("email", "spelled_email"):
        return 1 if re.split(r"[. ]", s)[-1].lower() in TOP_DOMAINS else -1
    if kind in ("card", "account"):
        return 1 if s[0] in "3456" and len(s) >= 13 else -1
    if kind == "phone":
        return 1 if s[1] != "0" else -1
    if kind == "secret":
        return 1 if re.search(r"(?i)(token|secret|passw|key|auth|bearer)\W{0,6}\Z", before) else -1 if before.endswith("/") else 0
    if kind == "name":
        return -1 if NOT_NAMES & set(s.split()) else 1 if s.split()[0] in GIVEN or TITLED.search(before) else 0
    return 0


def _shape(text: str, start: int, end: int, n_near: int) -> str:
    """Classes of the span and its surroundings, a digit each: length, digits, case, character before, character after, context words."""
    span = text[start:end]
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    case = 0 if not letters else 1 if span.islower() else 3 if span.isupper() else 2
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    side = lambda c: 0 if not c.strip() else 2 if c.isalnum() or c in "_/\\#" else 1
    share = 0 if not digits else 2 if digits + letters == digits else 1
    return f"{min(4, (end - start) // 8)}{share}{case}{side(left)}{side(right)}{min(2, n_near)}"


#: Number of classes of each digit of a shape.
CLASSES = (5, 3, 4, 3, 3, 3)


def votes(text: str, kind: str, start: int, end: int, others: list[int]) -> str:
    """Kind; one letter per labeler: f (for), a (against) or n (no vote); shape.  ``others``: sorted starts of the base spans."""
    span, before = text[start:end], text[max(0, start - 60) : start]
    near = re.findall(r"[^\W\d_]+", before.lower())[-6:]
    said = len(NEAR_WORDS[kind] & set(near))
    spread = _variety(span)
    i, j = bisect_left(others, start) - 1, bisect_right(others, start)
    gap = min(start - others[i] if i >= 0 else 10**9, others[j] - start if j < len(others) else 10**9)
    ballots = (
        _form(kind, span),
        _check(kind, span),
        _listed(kind, span, before),
        1 if said else 0,
        -1 if AGAINST & set(near[-3:]) else 0,
        0 if kind == "name" else 1 if spread >= 2.5 else -1 if spread < 1.5 else 0,
        1 if gap < 200 else 0,
        -1 if before[-1:] in ("/", "#", "_", "\\") else 1 if before[-1:] in ("", " ", "\n", ":", "(", "<", '"', "'") else 0,
    )
    return kind + ":" + "".join("anf"[b + 1] for b in ballots) + ":" + _shape(text, start, end, said)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("base", pa.bool_())])


def _scan(batches):
    from nameloom.llm.wordhash import release, text_pieces

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(SPAN)]
    for batch in batches:
        for lo, hi, texts in text_pieces(batch.column("text")):
            rows: list[tuple] = []
            for text in texts:
                text = text or ""
                base = base_spans(text) if re.search("[0-9@]", text) else []
                more = apart(added_candidates(text), base)
                starts = sorted(s for _, s, _ in base)
                listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                found = [{"kind": k, "start": a, "end": b, "pattern": votes(text, k, a, b, starts), "base": i < len(base)} for i, (k, a, b) in enumerate(base + more)]
                rows.append((*(sum(k == x for k, _, _ in base) for x in BASE), hashlib.sha256(listed.encode()).hexdigest(), listed, found))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), *columns], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "base_spans", "found"])
    release()


SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string, found array<struct<kind: string, start: bigint, end: bigint, pattern: string, base: boolean>>"


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over (pattern, count): P(vote | class) as (labeler, class, vote) and P(personal) of each pattern."""
    kinds = [p.split(":")[0] for p, _ in patterns]  # a pattern's shape, if it has one, is not looked at
    kind = np.array([KINDS.index(k) for k in kinds])
    ballot = np.array([["anf".index(v) for v in p.split(":")[1]] for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    labelers = ballot.shape[1]
    belief = 1 / (1 + np.exp(-(ballot - 1).sum(axis=1).astype(float)))  # start: the majority
    for _ in range(rounds):
        both = np.stack([1 - belief, belief]) * n
        rate = np.stack([[[both[c][ballot[:, j] == v].sum() for v in range(3)] for c in range(2)] for j in range(labelers)]) + 1.0
        rate /= rate.sum(axis=2, keepdims=True)
        prior = np.array([(both[1][kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        score = np.log(prior[kind] / (1 - prior[kind])) + sum(np.log(rate[j, 1, ballot[:, j]] / rate[j, 0, ballot[:, j]]) for j in range(labelers))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done, belief = np.abs(new - belief).max() < 1e-9, new
        if done:
            break
    return rate, belief


def features(pattern: str) -> np.ndarray:
    """Kind, votes, shape, and shape within the kind."""
    kind, ballot, shape = pattern.split(":")
    k, bits = KINDS.index(kind), sum(CLASSES)
    x = np.zeros(1 + len(KINDS) + 2 * len(ballot) + (1 + len(KINDS)) * bits)
    x[0] = x[1 + k] = 1
    for j, v in enumerate(ballot):
        if v != "n":
            x[1 + len(KINDS) + 2 * j + (v == "f")] = 1
    at = 1 + len(KINDS) + 2 * len(ballot)
    for c, size in zip(shape, CLASSES):
        x[at + int(c)] = x[at + (1 + k) * bits + int(c)] = 1
        at += size
    return x


def fit_classifier(patterns: list[tuple[str, int]], belief: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    x = np.stack([features(p) for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (belief - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Up to so many of the most frequent patterns the classifier is fitted to.
FIT_PATTERNS = 20_000
ADD = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string, found array<struct<kind: string, start: bigint, end: bigint, pattern: string, base: boolean>>, added array<struct<kind: string, start: bigint, end: bigint>>, spans string"


def _add(weights: np.ndarray, threshold: float):
    """Score every candidate; ``added`` are the accepted ones, ``spans`` the base spans and these."""
    known: dict[str, bool] = {}

    def good(pattern: str) -> bool:
        if pattern not in known:
            if len(known) >= 100_000:
                known.clear()
            known[pattern] = 1 / (1 + math.exp(-float(np.clip(features(pattern) @ weights, -30, 30)))) >= threshold
        return known[pattern]

    def rows(batches):
        kept = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            added, spans = [], []
            for listed, found in zip(batch.column("base_spans").to_pylist(), batch.column("found")):
                more = sorted((s["kind"], s["start"], s["end"]) for s in found.as_py() if not s["base"] and good(s["pattern"]))
                added.append([dict(zip(("kind", "start", "end"), s)) for s in more])
                spans.append(",".join([listed] * bool(listed) + [f"{k}:{a}:{b}" for k, a, b in more]))
            yield pa.record_batch([*batch.columns, pa.array(added, kept), pa.array(spans, pa.string())], names=[*batch.schema.names, "added", "spans"])

    return rows


def find_pii(docs: DataFrame, threshold: float = 0.5, fit_patterns: int = FIT_PATTERNS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base_spans, found, added, spans of every row."""
    scanned = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCAN), "pii-scan")
    counts = scanned.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "pii-patterns")
    ballots = counts.groupBy(F.substring_index("pattern", ":", 2).alias("ballot")).agg(F.sum("n").alias("n"))
    ballots = sorted((r["ballot"], r["n"]) for r in ballots.collect())  # bounded: kinds * 3**8
    if not ballots:
        return scanned.withColumns({"added": F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>"), "spans": F.col("base_spans")})
    _, belief = reliabilities(ballots)
    believed = dict(zip((b for b, _ in ballots), belief))
    patterns = [(r["pattern"], r["n"]) for r in counts.orderBy(F.col("n").desc(), "pattern").limit(fit_patterns).collect()]
    weights = fit_classifier(patterns, np.array([believed[p.rpartition(":")[0]] for p, _ in patterns]))
    return scanned.mapInArrow(_add(weights, threshold), ADD)
