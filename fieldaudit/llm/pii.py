"""Personal data by weak supervision (operator 6).

Base patterns find e-mail addresses, IP addresses, card and phone numbers; those spans always stay. Looser patterns propose
further spans: addresses written out, phone numbers without a plus sign, secrets. On every proposal, base ones
included, ``LABELERS`` vote yes, no or abstain: strict shapes, checksums and randomness, gazetteers, the words before, the
neighbouring characters. Proposals with the same votes and features are alike, so they are counted, and the counts (bounded by
the number of vote patterns) are all that reaches the driver. Expectation-maximisation estimates each labeler's reliability
per kind, and a logistic span classifier is trained on votes and features with these posteriors as soft labels; it decides on
the proposals that no base span covers.

Texts are read once, in a narrow step; only spans leave it. Offsets are code points of the text as it is.

Defined cases: a null or empty text has no spans; overlapping proposals of one kind keep the leftmost; no proposals at all mean
no model and no further spans; repeated rows are treated alike; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import keep

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
MAIL_HERE = re.compile(MAIL)
#: A match can start only where a run of its first class starts: the same matches, in time linear in the run.
MAIL_START = re.compile(r"(?<![A-Za-z0-9._%+-])" + MAIL)
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}"
                        r"(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,5}")
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,512}(?![A-Za-z0-9_-])")

#: Fixed lists of the gazetteer and context labelers.
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app ai co uk de fr es it nl be ch at eu us ca au br in jp cn ru pl se no dk fi".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
SECRET_STARTS = ("AKIA", "ASIA", "sk-", "sk_", "pk_", "ghp_", "gho_", "xoxb-", "xoxp-", "AIza", "eyJ")
WORDS_BEFORE = {
    "email": re.compile(r"(?i)\b(e-?mail|contact|write|mailto|address|correo|courriel|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|from|client)\b"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|credit|amex|tarjeta|carte|karte)\b"),
    "phone": re.compile(r"(?i)\b(phone|tel|telephone|call|mobile|fax|cell|telefon|tel[ée]fono|t[ée]l[ée]phone|handy)\b"),
    "secret": re.compile(r"(?i)(token|secret|password|passwd|api[_-]?key|access[_-]?key|credential|bearer)\W*$"),
}
OTHER_WORDS = re.compile(r"(?i)\b(version|isbn|issn|page|figure|section|chapter|commit|sha1|md5|checksum|revision|rfc|total)\b")
YES, NO, NONE = "1", "0", "-"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap. After a match the next may start inside the same run of characters."""
    at = 0
    while m := MAIL_HERE.match(text, at) or MAIL_START.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        found["email"] = list(mails(text))
    if re.search("[0-9]", text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(int(p[-400:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15]
    return found


def loose_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if re.search(r"[\[(](?:at|AT)[\])]", text):
        yield from (("email", *m.span()) for m in LOOSE_MAIL.finditer(text))
    if re.search("[0-9]", text):
        yield from (("phone", *m.span()) for m in LOOSE_PHONE.finditer(text))
        yield from (("secret", *m.span()) for m in SECRET.finditer(text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()))


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def vote(yes: bool, no: bool) -> str:
    return YES if yes else NO if no else NONE


def by_shape(kind: str, value: str, before: str, after: str) -> str:
    if kind == "secret":
        return vote(bool(re.fullmatch(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})", value)) or value.startswith(SECRET_STARTS), sum(c.isdigit() for c in value) < 3)
    if kind == "phone":
        return vote(bool(re.fullmatch(r"\+[0-9]{1,3}[ .(-].*|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}", value)), bool(re.fullmatch(r"[0-9]{4} [0-9]{4}( [0-9]{4})?", value)))
    if kind == "email":
        return vote(bool(MAIL_HERE.fullmatch(value)), False)
    return YES


def by_content(kind: str, value: str, before: str, after: str) -> str:
    if kind == "secret":
        e = entropy(value)
        return vote(e >= 3.2 and sum(c.isdigit() for c in value) >= 4, e < 2.8)
    digits = re.sub("[^0-9]", "", value)
    if kind in ("card", "phone"):
        return vote(kind == "card" and luhn(digits), len(set(digits)) < 3)
    return NONE


def by_gazetteer(kind: str, value: str, before: str, after: str) -> str:
    if kind == "email":
        return vote(re.split(r"[^A-Za-z0-9-]+", value)[-1].lower() in ENDINGS, False)
    if kind == "phone" and value.startswith("+"):
        return vote(any(value[1:1 + n] in CALLING_CODES for n in (1, 2)), False)
    if kind == "secret":
        return vote(value.startswith(SECRET_STARTS), bool(re.fullmatch("[a-z]+(?:[-_][a-z0-9]+){2,}", value)))
    return NONE


def by_words_before(kind: str, value: str, before: str, after: str) -> str:
    return vote(bool(WORDS_BEFORE[kind].search(before)), bool(OTHER_WORDS.search(before)))


def by_neighbours(kind: str, value: str, before: str, after: str) -> str:
    if kind == "secret":
        return vote(bool(re.search(r"[=:]\s*[\"']?$", before)), bool(re.search(r"[/.?&#]$", before) or re.match(r"[/.]\w", after)))
    return vote(False, bool(re.search(r"[\w=/]$", before) or re.match(r"[\w/]", after)))


LABELERS: tuple[Callable[[str, str, str, str], str], ...] = (by_shape, by_content, by_gazetteer, by_words_before, by_neighbours)


def features(value: str) -> str:
    """Length and share of digits, in steps."""
    share = sum(c.isdigit() for c in value) / len(value)
    return f"{min(4, len(value).bit_length() - 2)}{min(3, int(share * 4))}"


RESULT = ("base array<struct<kind: int, start: long, end: long>>, "
          "proposed array<struct<kind: int, start: long, end: long, pattern: string>>, patterns array<string>")


def spans_of(text: str) -> tuple[list, list, list]:
    found = base_spans(text)
    base = [(KINDS.index(k), a, b) for k in BASE_KINDS for a, b in found[k]]
    covered = sorted((a, b) for _, a, b in base)
    describe = lambda kind, a, b: "|".join((
        kind, "".join(f(kind, text[a:b], text[max(0, a - 32):a], text[b:b + 8]) for f in LABELERS), features(text[a:b])))
    patterns = [describe(KINDS[k], a, b) for k, a, b in base]
    proposed, k, ended = [], 0, {}
    for kind, a, b in sorted(loose_spans(text), key=lambda s: (s[1], s[2])):
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if (k == len(covered) or covered[k][0] >= b) and ended.get(kind, 0) <= a:
            ended[kind] = b
            proposed.append((KINDS.index(kind), a, b, describe(kind, a, b)))
    return base, proposed, patterns + [p[3] for p in proposed]


def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [spans_of(t) if t else ([], [], []) for t in texts]
        yield pd.DataFrame({
            "base": pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in r[0]] for r in rows], dtype=object),
            "proposed": pd.Series([[{"kind": k, "start": a, "end": b, "pattern": p} for k, a, b, p in r[1]] for r in rows], dtype=object),
            "patterns": pd.Series([r[2] for r in rows], dtype=object)})


def reliabilities(votes: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each row, accuracy of each labeler) for votes of 1, 0 and -1 (abstains), weighted by ``n``.

    Accuracies carry pseudo-counts around 0.8 and stay above one half: labelers are better than chance. Both outcomes are
    equally likely beforehand: a prior learned along could outvote the labelers of a kind with few of them.
    """
    accuracy = np.full(votes.shape[1], 0.8)
    says = np.where(votes == 1, 1.0, np.where(votes == 0, -1.0, 0.0))
    for _ in range(steps):
        odds = says @ np.log(accuracy / (1 - accuracy))
        good = 1 / (1 + np.exp(-odds))
        right = n @ (np.where(votes == 1, good[:, None], 0) + np.where(votes == 0, 1 - good[:, None], 0))
        total = n @ (votes >= 0)
        accuracy = np.clip((right + 8) / (total + 10), 0.55, 0.99)
    return good, accuracy


def design(patterns: list[str]) -> np.ndarray:
    """Indicator columns of a pattern: a constant, each labeler's yes and no, the steps of the features."""
    rows = []
    for p in patterns:
        _, votes, (length, share) = p.split("|")
        rows.append([1.0, *(float(v == w) for v in votes for w in (YES, NO)), *(float(int(length) == k) for k in range(5)),
                     *(float(int(share) == k) for k in range(4))])
    return np.array(rows)


def logistic_fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps of ridge logistic regression on soft labels."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge * w
        w = w + np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), gradient)
    return w


def accepted_patterns(counted: list[tuple[str, int]]) -> dict[str, float]:
    """The classifier's chance for every pattern, kind by kind."""
    out: dict[str, float] = {}
    for kind in KINDS:
        rows = sorted((p, n) for p, n in counted if p.split("|")[0] == kind)
        if rows:
            names, n = [p for p, _ in rows], np.array([c for _, c in rows], float)
            votes = np.array([[{YES: 1, NO: 0, NONE: -1}[v] for v in p.split("|")[1]] for p in names])
            good, _ = reliabilities(votes, n)
            x = design(names)
            w = logistic_fit(x, good, n)
            out.update(zip(names, (1 / (1 + np.exp(-(x @ w)))).tolist()))
    return out


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base (spans), added (spans the method adds) of every document; spans are sorted by kind, start and end."""
    found = keep(docs.select(F.col(key).alias("key"), F.pandas_udf(find, RESULT)(F.col(text)).alias("f")).select("key", "f.*"), "spans")
    counted = found.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    # At most kinds * 3^labelers * 20 patterns, whatever the number of documents.
    chances = accepted_patterns([(r.pattern, r.n) for r in counted.collect()])
    good = F.array(*(F.lit(p) for p, c in sorted(chances.items()) if c >= 0.5)).cast("array<string>")
    added = F.transform(F.filter("proposed", lambda s: F.array_contains(good, s["pattern"])),
                        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("key", "base", added.alias("added"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their spans written over by the kind, for callers that want texts; joined by a unique key."""
    spans = personal_data(docs, key, text).select("key", F.array_sort(F.concat("base", "added")).alias("spans"))

    def blank(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            out = []
            for t, s in zip(texts, found):
                if t is not None and s is not None:
                    last = len(t)
                    for x in sorted(s, key=lambda x: -x["start"]):
                        if x["end"] <= last:
                            t, last = f"{t[:x['start']]}[{KINDS[x['kind']]}]{t[x['end']:]}", x["start"]
                out.append(t)
            yield pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("row")).withColumn("key", F.col(f"row.{key}"))
    rows = rows.join(spans, rows["key"].eqNullSafe(spans["key"]), "left")
    return rows.select(F.col("row").withField(text, F.pandas_udf(blank, "string")(F.col(f"row.{text}"), F.col("spans"))).alias("row")).select("row.*")
