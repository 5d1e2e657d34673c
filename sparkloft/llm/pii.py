"""Personal data by weak supervision: fixed patterns, and further spans that labelers vote on and a trained classifier accepts."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloft.llm.common import small_batches, written

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.8  # probability from which a candidate becomes a span
NEAR = 48  # characters before and after a candidate that the context labelers read
ROUNDS = 200

# Fixed values of the base patterns. Their quantifiers do not give back where that cannot change a match, so long runs stay linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider patterns: who is a candidate.
_AT = ("[at]", "(at)", " at ", " arobase ", " ät ", " arroba ")
_DOT = r"(?:\x20?(?:\[dot\]|\(dot\)|\[\.\])\x20?|\.|\x20dot\x20|\x20punkt\x20|\x20point\x20|\x20punto\x20)"
_SPOKEN = re.compile(rf"\x20?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}")
_WORD_BEFORE = re.compile(r"[\w.+%-]{1,64}\x20?$")
_ANY_AT = re.compile(r"\x20?[\w-]{1,63}(?:\.[\w-]{1,63}){1,6}")
_SPACED_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20|\.\x20)[0-9]{1,3}){3}(?![\w.]*[0-9])")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:){2,8}(?:[0-9A-Fa-f]{1,4})?(?![\w:])")
_PARTED_CARD = re.compile(r"(?<![\w])[0-9]{4}(?:(?:\x20\x20|\x20?[./_‐-—-]\x20?)[0-9]{4}){3}(?![\w])")
_LOCAL_PHONE = re.compile(r"(?<![\w.,/+#=@-])\(?[0-9]{2,5}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){1,5}(?![\w@-])|(?<![\w.,/+#=@-])00[1-9][0-9]{8,12}(?![\w@-])")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}")
_DIGIT = re.compile("[0-9]")

# Gazetteers and cue words: fixed lists, lower case.
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app ai co eu de at ch fr be es pt it nl uk us ca mx ar cl br pl se no dk fi ie au nz jp cn in example test".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "81", "86", "90", "91", "351", "353", "358")
CUES = {
    "email": frozenset("mail email e-mail mails contact contacts kontakt courriel courriels correo write écrire schreiben escriba address adresse".split()),
    "ip": frozenset("ip ips ipv4 ipv6 host hosts server servers address addresses adresse serveur servidor dirección client login".split()),
    "card": frozenset("card cards visa mastercard amex credit debit karte karten kreditkarte carte cartes tarjeta crédito cc payment".split()),
    "phone": frozenset("phone phones tel tél call calls mobile cell fax telefon handy anruf anrufen téléphone appelez appeler teléfono llame llamar móvil whatsapp".split()),
}
AGAINST = frozenset("version versions v isbn issn doi order orders invoice token hash page pages section chapter article license figure table build release date code part serial rfc §".split())
WORD = re.compile(r"[\w§-]+")

LABELERS = ("shape", "gazetteer", "before", "after", "company", "grouping")
SHAPES = ("opens_line", "after_colon", "in_brackets", "parted", "long", "leading_zero")
_NO, _ABSTAIN, _YES = 0, 1, 2


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _positions(text: str, what: str) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """((kind, start, end) of the base patterns' matches, those that a kind's check drops); each kind leftmost and without overlaps."""
    kept, dropped = [], []
    end = 0
    for at in _positions(text, "@"):
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            kept.append((0, start, end := m.end()))
    for m in _IP.finditer(text) if "." in text else ():
        fits = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))
        (kept if fits else dropped).append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19:
                (kept if luhn(digits) else dropped).append((2, m.start(), m.end()))
    end = 0
    for at in _positions(text, "+"):
        if at >= end and (m := _PHONE.match(text, at)):
            end = m.end()
            (kept if 9 <= len(_digits(m.group())) <= 15 else dropped).append((3, at, end))
    return kept, dropped


def candidates(text: str, dropped: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what wider patterns find; they may overlap each other and the base spans."""
    found = list(dropped)
    for mark in _AT:
        for at in _positions(text, mark):
            right = _SPOKEN.match(text, at + len(mark))
            if right and (mark[0] != " " or not right.group().strip().replace("-", "").isalnum()):
                left = _WORD_BEFORE.search(text[max(0, at - 65) : at])
                if left:
                    found.append((0, at - len(left.group()), right.end()))
    for at in _positions(text, "@"):
        left, right = _WORD_BEFORE.search(text[max(0, at - 65) : at]), _ANY_AT.match(text, at + 1)
        if left and right:
            found.append((0, at - len(left.group()), right.end()))
    if ":" in text:
        found += [(1, m.start(), m.end()) for m in _IP6.finditer(text)]
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _SPACED_IP.finditer(text)]
        found += [(2, m.start(), m.end()) for m in _PARTED_CARD.finditer(text)]
        found += [(3, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text) if 7 <= len(_digits(m.group())) <= 15]
    return found


def _issuer(digits: str) -> bool:
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    if digits[0] == "4":
        return n in (13, 16, 19)
    if 51 <= two <= 55 or 2221 <= four <= 2720:
        return n == 16
    if two in (34, 37):
        return n == 15
    return two in (30, 36, 38) and n == 14 or four == 6011 and n == 16 or two in (35, 62, 64, 65) and 16 <= n <= 19


def _plain_email(text: str) -> str:
    text = re.sub(r"\x20?(?:\[at\]|\(at\))\x20?|\x20(?:at|arobase|ät|arroba)\x20|\x20?@\x20?", "@", text)
    return re.sub(_DOT, ".", text).strip()


def _shape(kind: int, text: str, digits: str) -> int:
    """The pattern labeler: whether the span is what such data look like in full."""
    if kind == 0:
        local, _, host = _plain_email(text).partition("@")
        return _YES if local and re.fullmatch(r"[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,24}", host) else _NO
    if kind == 1:
        plain = text if ":" in text else re.sub(r"[^0-9.]", "", text)
        try:
            return _YES if ipaddress.ip_address(plain) and plain.count(":") not in (1,) else _NO
        except ValueError:
            return _NO
    if kind == 2:
        return _YES if luhn(digits) else _NO
    if _DATE.fullmatch(text) or not 9 <= len(digits) <= 15:
        return _NO
    return _YES if text[0] in "+(0" or re.fullmatch(r"[2-9][0-9]{2}[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}", text) else _ABSTAIN


def _gazetteer(kind: int, text: str, digits: str) -> int:
    if kind == 0:
        return _YES if _plain_email(text).rpartition(".")[2].lower() in ENDINGS else _NO
    if kind == 1:
        return _NO if digits[:1] == "0" or not digits else _ABSTAIN
    if kind == 2:
        return _YES if _issuer(digits) else _NO
    international = digits[2:] if digits.startswith("00") else digits if text[0] == "+" else None
    if international is None:
        return _ABSTAIN
    return _YES if international.startswith(CALLING) else _NO


def _context(words: list[str], kind: int) -> int:
    found = set(words)
    if found & CUES[KINDS[kind]]:
        return _YES
    return _NO if found & AGAINST else _ABSTAIN


def _grouping(kind: int, text: str, digits: str) -> int:
    if kind >= 2 and (len(set(digits)) <= 2 or digits in "01234567890123456789" or digits in "98765432109876543210"):
        return _NO
    groups = [len(g) for g in re.findall(r"[0-9]+", text)]
    if kind == 2:
        return _YES if groups in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4]) else _ABSTAIN
    if kind == 3:
        return _YES if groups[-1] == 4 and 3 in groups else _ABSTAIN if len(groups) > 1 else _NO
    return _ABSTAIN


def described(text: str, span: tuple[int, int, int], base: list[tuple[int, int, int]]) -> tuple[int, int]:
    """(votes, shapes) of a span as numbers: a digit of base 3 for each labeler, a bit for each feature of its form and place."""
    kind, start, end = span
    own = text[start:end].strip()
    digits = _digits(own)
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    company = any(0 < max(s - end, start - e) <= 4 * NEAR for _, s, e in base if (s, e) != (start, end))
    votes = (
        _shape(kind, own, digits), _gazetteer(kind, own, digits), _context(WORD.findall(before.lower())[-5:], kind),
        _context(WORD.findall(after.lower())[:3], kind), _YES if company else _ABSTAIN, _grouping(kind, own, digits)
    )
    trimmed = before.rstrip(" ")
    shapes = (
        not trimmed or trimmed[-1] == "\n", trimmed[-1:] in (":", "="), before[-1:] in ("(", "[", "<", '"'),
        any(c in own for c in " .-/()"), len(own) > 16, digits[:1] == "0"
    )
    return sum(v * 3**i for i, v in enumerate(votes)), sum(int(s) << i for i, s in enumerate(shapes))


_FOUND = "doc_id long, base array<struct<kind: int, start: int, end: int>>, others array<struct<kind: int, start: int, end: int, votes: int, shapes: int>>, anchors array<struct<kind: int, votes: int, shapes: int>>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, others, anchors) of every row: base spans, candidates that overlap none of them with their votes, and the base spans' own votes."""

    def run(batches):
        for b in batches:
            base, others, anchors = [], [], []
            for x in b.column(1):
                text = x.as_py() or ""
                kept, dropped = base_spans(text)
                taken = sorted((s, e) for _, s, e in kept)
                starts = np.array([s for s, _ in taken])
                ends = np.array([e for _, e in taken])
                most = np.maximum.accumulate(ends) if len(ends) else ends

                def free(span, starts=starts, most=most):
                    i = np.searchsorted(starts, span[2]) - 1  # the last base span that begins before the candidate's end
                    return i < 0 or most[i] <= span[1]

                mine = sorted({span for span in candidates(text, dropped) if free(span)})
                near = sorted(kept, key=lambda s: s[1])
                at = [s for _, s, _ in near]

                def around(span, near=near, at=at):
                    i = np.searchsorted(at, span[1]) if at else 0
                    return near[max(0, i - 4) : i + 4]

                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in kept])
                others.append([dict(zip(("kind", "start", "end", "votes", "shapes"), s + described(text, s, around(s)), strict=True)) for s in mine])
                anchors.append([dict(zip(("kind", "votes", "shapes"), (s[0], *described(text, s, around(s))), strict=True)) for s in kept])
            span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
            said = [("votes", pa.int32()), ("shapes", pa.int32())]
            kinds = [pa.list_(pa.struct(fields)) for fields in (span, span + said, span[:1] + said)]
            lists = [pa.array(v, k) for v, k in zip((base, others, anchors), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "base", "others", "anchors"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def _votes(numbers: np.ndarray) -> np.ndarray:
    return numbers[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def reliabilities(votes: np.ndarray, n: np.ndarray, anchor: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(P(vote | truth) by labeler, truth and vote; P(true) of each pattern) by expectation-maximisation.

    votes: a row for each pattern, n: how often it occurs, anchor: whether it is a base span, which is true. Labelers are taken as
    independent given the truth; the counts that each starts with say that it is right four times in five when it votes at all.
    """
    prior = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # truth by vote
    score = (votes - _ABSTAIN).sum(1)
    truth = np.where(anchor, 1.0, 1 / (1 + np.exp(-score)))
    open_ = ~anchor
    odds = None
    for _ in range(rounds):
        share = (n[open_] @ truth[open_] + 1) / (n[open_].sum() + 2)
        weight = np.stack([n * (1 - truth), n * truth])
        counts = np.stack([np.stack([np.bincount(votes[:, j], weight[z], 3) for z in (0, 1)]) for j in range(votes.shape[1])]) + prior
        odds = counts / counts.sum(2, keepdims=True)
        log = np.log(odds)
        each = sum(log[j, 1, votes[:, j]] - log[j, 0, votes[:, j]] for j in range(votes.shape[1])) + np.log(share / (1 - share))
        new = np.where(anchor, 1.0, 1 / (1 + np.exp(-np.clip(each, -50, 50))))
        if np.abs(new - truth).max() < 1e-9:
            truth = new
            break
        truth = new
    return odds, truth


def _features(votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    bits = shapes[:, None] >> np.arange(len(SHAPES)) & 1
    said = np.concatenate([votes == _YES, votes == _NO], 1)
    return np.concatenate([np.ones((len(votes), 1)), said, bits], 1).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """By kind: what each labeler's votes are worth, and the span classifier's weights (None where the corpus has no candidate)."""

    reliabilities: tuple
    weights: tuple

    def probability(self, kind: int, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        if self.weights[kind] is None:
            return np.zeros(len(votes))
        return 1 / (1 + np.exp(-np.clip(_features(_votes(votes), shapes) @ self.weights[kind], -30, 30)))


def train(found: DataFrame) -> Model:
    """The model of all candidates and base spans of ``found``.

    What comes to the driver is how often each pattern of votes and shapes occurs: at most 4 kinds x 3^6 votes x 2^6 shapes x 2 rows
    of numbers, whatever the size of the corpus; every span counts.
    """
    each = found.select(F.explode("others").alias("s")).select("s.kind", "s.votes", "s.shapes", F.lit(False).alias("anchor"))
    each = each.unionByName(found.select(F.explode("anchors").alias("s")).select("s.kind", "s.votes", "s.shapes", F.lit(True).alias("anchor")))
    rows = sorted(map(tuple, each.groupBy("kind", "votes", "shapes", "anchor").count().collect()))
    worth, weights = [], []
    for kind in range(len(KINDS)):
        mine = [r for r in rows if r[0] == kind]
        if not any(not r[3] for r in mine):
            worth.append(None)
            weights.append(None)
            continue
        votes, shapes, anchor, n = (np.array([r[i] for r in mine]) for i in (1, 2, 3, 4))
        odds, truth = reliabilities(_votes(votes), n.astype(float), anchor)
        worth.append(odds)
        weights.append(_logistic(_features(_votes(votes), shapes), truth, n.astype(float)))
    return Model(tuple(worth), tuple(weights))


def accepted(others: list[dict], model: Model, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """The candidates that the classifier takes; of those that overlap, the most probable, then by kind and place."""
    scored = []
    for kind in range(len(KINDS)):
        mine = [s for s in others if s["kind"] == kind]
        if mine:
            p = model.probability(kind, np.array([s["votes"] for s in mine]), np.array([s["shapes"] for s in mine]))
            scored += [(-q, kind, s["start"], s["end"]) for q, s in zip(p, mine, strict=True) if q >= threshold]
    taken: list[tuple[int, int, int]] = []
    chosen = np.empty((0, 2), np.int64)
    for _, kind, start, end in sorted(scored):
        if not ((chosen[:, 0] < end) & (chosen[:, 1] > start)).any():
            taken.append((kind, start, end))
            chosen = np.concatenate([chosen, [[start, end]]])
    return taken


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of ``docs``.

    docs: (doc_id, text, ...); other columns are left alone. The four counts and the digest are of the base patterns' spans, which always stay;
    ``spans`` has these and the n_added ones of the classifier, as kind:start:end in code points, by kind (email, ip, card, phone), then start.
    Added spans overlap no base span and no other added span. A null text is an empty one; repeated rows give repeated rows and count twice
    in training; an empty table gives no row. Whole texts are read once; a small table of spans is written, read for training and
    for the result. Nothing is shuffled but counts of patterns.
    """
    found = written(find(docs), "personal-data")
    model = train(found)

    def run(batches):
        for b in batches:
            out = []
            for base, others in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                base = [(s["kind"], s["start"], s["end"]) for s in base]
                added = accepted(others, model, threshold) if others else []
                plain, whole = (",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans)) for spans in (base, base + added))
                n = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                out.append((*n, hashlib.sha256(plain.encode()).hexdigest(), whole, len(added)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return found.select("doc_id", "base", "others").mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
