r"""Personal data in texts: base patterns, and more spans found by weak supervision.

*Candidates.* The base kinds are found by their patterns and checks and always stay. Further kinds
(`ADDED`) are found by wide patterns that match much that is harmless: spelled-out addresses, telephone numbers
without a country, account numbers, IBANs, social security numbers, names.

*Votes.* Every candidate, base ones too, is put to `LABELERS`: patterns (the strict form and its check digits, regular
groups, placeholder values), gazetteers (top-level domains, dial codes, card issuers, first names) and context (words
before that announce such data, words that announce something else, whether it stands inside a longer token).
Each says yes, no or nothing.

*Aggregation.* No candidate has a label. Expectation-maximisation finds, from how votes agree, how often each
labeler says what of personal and of harmless spans, and how likely each span is personal. It needs only how many
candidates of a kind got which votes: counted over all documents in Spark, at most ``3 ** len(LABELERS)`` numbers a kind.

*Classifier.* A logistic regression learns these probabilities from what the labelers do not read: the shape
of the span, its characters, the words around it. It is fitted on `SAMPLE` different candidates, taken by a hash. Added
candidates that it gives `LIMIT` or more are spans; so are all base ones.

Texts are read in two narrow passes, fitting and finding; nothing but counts and the sample is shuffled.
Patterns are written so that no text takes more than linear time.

Defined results: null and empty texts have no spans; places are code points, the end exclusive; spans of one kind
do not overlap, added ones overlap no base one; repeated rows have equal spans; an empty table fits a model that adds
nothing. Other columns are neither read nor changed, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsearch.llm import words as wd
from braidsearch.session import materialize

# Different candidates on which the classifier is fitted, its hashed features, least probability of a span.
SAMPLE = 20_000
BITS = 14
LIMIT = 0.5
# Characters of context that labelers and the classifier see before and after a span.
BEFORE, AFTER = 48, 24

BASE = ("email", "ip", "card", "phone")
ADDED = ("spelled", "ssn", "local", "iban", "account", "name")
KINDS = BASE + ADDED

# Base patterns. Possessive runs give the same matches, in linear time; a pattern that begins with a set
# of characters is searched for faster than one that begins with a look behind, which therefore comes second.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9](?<![0-9].)[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Wide patterns of the added kinds.
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}(?: at | ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]{1,64}(?: dot | ?\(dot\) ?| ?\[dot\] ?)[A-Za-z]{2,24}(?![A-Za-z])"
)
LOCAL = re.compile(r"[(0-9](?<![0-9+].)[0-9]{1,4}\)?[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NAME = re.compile(r"[A-Z](?<![A-Za-z].)[a-z]{1,20} [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?(?![A-Za-z])")
TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? $")

# Gazetteers.
FIRST_NAMES = frozenset(
    """Anna Anne Antonio Barbara Carlos Carmen Charles Charlotte Christian Christine Claire Claudia Daniel David
    Elena Elizabeth Emily Emma Eva Francisco Frank George Hans Helen Isabel Jack Jacques James Jan Jane Jean
    Jennifer John Jorge José Joseph Juan Julia Karl Klaus Laura Linda Louis Lucas Lucia Luis Manuel Maria Marie
    Mark Markus Martin Mary Michael Michel Miguel Nicolas Olivier Patricia Paul Pedro Peter Pierre Richard Robert
    Sarah Sofia Sophie Stefan Susan Susanne Thomas Ursula William Wolfgang""".split()
)
DOMAINS = frozenset(
    """com org net edu gov mil int info biz io de fr es uk it nl eu ch at be se no dk fi pl pt ru us ca mx br ar
    jp cn in au nz za ie cz gr""".split()
)
DIAL_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
)
CUES = {
    "email": "mail email contact write address courriel correo adresse",
    "ip": "ip host server address from login client",
    "card": "card visa mastercard amex credit debit carte karte tarjeta payment",
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono number",
    "account": "account acct konto compte cuenta customer card passport",
    "iban": "iban account konto compte cuenta bank",
    "ssn": "ssn social security insurance tax",
    "name": "name named call am from dear by mr mrs ms dr prof herr frau",
}
CUES["spelled"], CUES["local"] = CUES["email"], CUES["phone"]
CUES = {kind: frozenset(words.split()) for kind, words in CUES.items()}
OTHERS = frozenset(
    """version v release build figure fig table section chapter page isbn issn doi part ref order invoice price total
    usd eur commit hash checksum id port line step year item""".split()
)
PLACEHOLDERS = re.compile(r"test|example|sample|noreply|no-reply|dummy|localhost|1234567|0000000|(?:^|\D)0\.0\.|127\.0\.0\.")
WORD = re.compile(r"[^\W_]+")


def _luhn(digits: str) -> bool:
    total = 0
    for n, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + n % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for found in DOMAIN.finditer(text):
        start = found.start()
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < found.start():  # a match; without a local part the next one may begin in this domain
            end = found.end()
            yield start, end


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base spans, kind by kind."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", *span) for span in _emails(text)]
    for match in IP.finditer(text):
        if all(map(_byte, match.group().split("."))):
            found.append(("ip", *match.span()))
    for match in DIGITS.finditer(text):
        if match.end() - match.start() >= 12:
            digits = _digits(match.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *match.span()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(_digits(match.group())) <= 15:
                found.append(("phone", *match.span()))
    return found


def added_candidates(text: str, base: list[Span]) -> list[Span]:
    """What may be personal data beyond ``base``; overlaps go to the earlier start, then the earlier kind."""
    found: list[Span] = []
    if "dot" in text:
        found += [("spelled", *match.span()) for match in SPELLED.finditer(text)]
    found += [("ssn", *match.span()) for match in SSN.finditer(text)]
    found += [("local", *match.span()) for match in LOCAL.finditer(text)]
    for match in DIGITS.finditer(text):
        if match.end() - match.start() >= 8 and 8 <= len(_digits(match.group())) <= 19:
            found.append(("account", *match.span()))
    found += [("iban", *match.span()) for match in IBAN.finditer(text)]
    for match in NAME.finditer(text):
        first = match.group().split(" ", 1)[0]
        if first in FIRST_NAMES or TITLE.search(text, max(0, match.start() - 12), match.start()):
            found.append(("name", *match.span()))
    if not found:
        return []
    taken = sorted((start, end) for _, start, end in base)
    starts = [start for start, _ in taken]
    reach = np.maximum.accumulate([end for _, end in taken]) if taken else np.zeros(0, int)
    free, last = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        before = int(np.searchsorted(starts, end))
        if start >= last and (not before or reach[before - 1] <= start):
            free.append((kind, start, end))
            last = end
    return free


# --- labelers: yes 1, no 0, nothing -1


@dataclass
class Seen:
    """A candidate with its surroundings."""

    kind: str
    value: str
    before: str
    after: str

    def __post_init__(self):
        self.digits = _digits(self.value)
        self.words = [word.lower() for word in WORD.findall(self.before)][-4:]


def strict(seen: Seen) -> int:
    """The strict form of the kind, with check digits where it has them."""
    value, digits = seen.value, seen.digits
    if seen.kind == "email":
        local, domain = value.split("@")
        return int(".." not in local and local[0] not in ".-+%" and local[-1] != "." and domain.rsplit(".", 1)[1].isalpha())
    if seen.kind == "ip":
        return int(all(part == "0" or part[0] != "0" for part in value.split(".")))
    if seen.kind == "card":
        return int(13 <= len(digits) <= 19 and digits[0] in "3456")
    if seen.kind in ("phone", "local"):
        return int(value.count("(") == value.count(")") and len(digits) >= 10)
    if seen.kind == "account":
        return 0  # nothing checks
    if seen.kind == "iban":
        plain = value.replace(" ", "")
        return int(int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    if seen.kind == "ssn":
        return int(value[:3] not in ("000", "666") and value[0] != "9" and "00" != value[4:6] and value[7:] != "0000")
    return -1


def grouped(seen: Seen) -> int:
    """Digits in regular groups say yes, a single repeated digit says no."""
    if not seen.digits:
        return -1
    if len(set(seen.digits)) <= 2:
        return 0
    sizes = [len(run) for run in re.findall("[0-9]+", seen.value)]
    if seen.kind in ("card", "account"):
        return 1 if set(sizes[:-1]) == {4} else -1
    if seen.kind in ("phone", "local"):
        return 1 if len(sizes) >= 3 and max(sizes) <= 4 else -1
    return -1


def placeholder(seen: Seen) -> int:
    return 0 if PLACEHOLDERS.search(seen.value.lower()) else -1


def listed(seen: Seen) -> int:
    """Gazetteers of domains, dial codes, card issuers and first names."""
    if seen.kind in ("email", "spelled"):
        return 1 if re.split(r"[. )\]]", seen.value.lower())[-1] in DOMAINS else 0
    if seen.kind == "phone":
        return 1 if any(seen.digits[:n] in DIAL_CODES for n in (1, 2)) else 0
    if seen.kind == "card":
        return 1 if re.match("4|5[1-5]|2[2-7]|3[47]|6(?:011|5)", seen.digits) else -1
    if seen.kind == "name":
        return 1 if seen.value.split(" ", 1)[0] in FIRST_NAMES else -1
    return -1


def announced(seen: Seen) -> int:
    return 1 if CUES[seen.kind] & set(seen.words) else -1


def announced_other(seen: Seen) -> int:
    return 0 if OTHERS & set(seen.words[-2:]) else -1


def embedded(seen: Seen) -> int:
    """Inside a longer token, as in addresses of pages and in code, or on its own."""
    left, right = seen.before[-1:], seen.after[:1]
    inside = (left.isalnum() or left in ("_", "/", "=", "#", "@", ".", "-")) and left != ""
    inside |= right.isalnum() or right in ("_", "=", "@") and right != ""
    return 0 if inside else 1


def titled(seen: Seen) -> int:
    return 1 if seen.kind == "name" and TITLE.search(seen.before) else -1


LABELERS: tuple[Callable[[Seen], int], ...] = (
    strict, grouped, placeholder, listed, announced, announced_other, embedded, titled,
)


def votes(seen: Seen) -> int:
    """All votes as one number, a digit of base 3 each."""
    return sum((labeler(seen) + 1) * 3**n for n, labeler in enumerate(LABELERS))


def _shape(text: str) -> str:
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in text)


def features(seen: Seen) -> list[int]:
    """Hashed features: kind, shapes, characters, length, words around; each once."""
    shape = _shape(seen.value[:64])
    short = re.sub(r"(.)\1+", r"\1", shape)
    after = WORD.findall(seen.after)
    names = [f"kind {seen.kind}", f"shape {short}", f"size {len(seen.value).bit_length()}", f"digits {len(seen.digits)}"]
    names += [f"before {word}" for word in seen.words[-2:]] + [f"after {word.lower()}" for word in after[:1]]
    names += [f"left {_shape(seen.before[-2:])}", f"right {_shape(seen.after[:2])}", f"end {shape[-4:]}"]
    names += [f"part {seen.value[n : n + 3].lower()}" for n in range(min(24, len(seen.value) - 2))]
    # a feature tells something else of each kind
    return sorted({crc32(f"{seen.kind} {name}".encode()) & ((1 << BITS) - 1) for name in names})


def _seen(text: str, span: Span) -> Seen:
    kind, start, end = span
    return Seen(kind, text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER])


# --- aggregation


def aggregate(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 200) -> np.ndarray:
    """P(personal) for each combination of kind and votes, by expectation-maximisation.

    Votes are independent given what a span is; a labeler says yes, no or nothing with its own chances for
    personal and for harmless spans, a kind is personal with its own chance. It starts from the majority; every chance
    is smoothed by one vote.
    """
    if not len(count):
        return np.zeros(0)
    cast = vote[:, None] // 3 ** np.arange(len(LABELERS)) % 3  # 0 nothing, 1 no, 2 yes
    yes, no = (cast == 2).sum(axis=1), (cast == 1).sum(axis=1)
    personal = (yes + 0.5) / (yes + no + 1)
    said = np.stack([cast == v for v in range(3)], axis=2).astype(float)
    of_kind = kind[:, None] == np.arange(len(KINDS))
    for _ in range(rounds):
        logs = []
        for belief in (1 - personal, personal):
            weight = belief * count
            chance = np.einsum("p,plv->lv", weight, said) + 1
            chance /= chance.sum(axis=1, keepdims=True)
            prior = (weight @ of_kind + 1) / (count @ of_kind + 2)
            logs.append(np.einsum("plv,lv->p", said, np.log(chance)) + np.log(prior)[kind])
        turned = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        moved = np.abs(turned - personal).max()
        personal = turned
        if moved < 1e-9:
            break
    return personal


def fit_classifier(held: list[np.ndarray], goal: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression on features present, the last one for all; ``goal`` are probabilities."""
    row = np.repeat(np.arange(len(held)), [len(r) for r in held])
    feature = np.concatenate([np.zeros(0, np.int64), *held]).astype(np.int64)
    size = (1 << BITS) + 1
    weights, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        margin = np.bincount(row, weights[feature], minlength=len(held)) + weights[-1]
        slope = weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - goal)
        step = np.append(np.bincount(feature, slope[row], minlength=size - 1), slope.sum()) + 1e-5 * weights
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step**2
        weights = weights - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return weights


@dataclass
class Model:
    """Weights of the span classifier, and for each kind and votes how likely such a span is personal."""

    weights: np.ndarray | None
    beliefs: dict[tuple[str, int], float]

    def probability(self, found: list[int]) -> float:
        if self.weights is None:
            return 0.0
        margin = self.weights[found].sum() + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, cast, held = [], [], []
        for text in batch.column(0).to_pylist():
            base = base_spans(text or "")
            for span in base + added_candidates(text or "", base):
                seen = _seen(text, span)
                kinds.append(KINDS.index(seen.kind))
                cast.append(votes(seen))
                held.append(features(seen))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(cast, pa.int32()), pa.array(held, pa.list_(pa.int32()))],
            names=["kind", "votes", "features"],
        )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind, votes, features, n`` of all candidates, those that agree in all counted as one."""
    found = docs.select(F.col(f"`{text}`")).mapInArrow(_candidates, "kind int, votes int, features array<int>")
    return found.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text: str = "text", rows: int = SAMPLE) -> Model:
    """A model of the table's own candidates; no labels are needed."""
    found = materialize(candidates(docs, text), "pii-candidates")
    # at most 3 ** len(LABELERS) rows for each kind
    cast = found.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).toPandas()
    cast = cast.sort_values(["kind", "votes"])
    kind, vote, count = (cast[name].to_numpy(np.int64) for name in ("kind", "votes", "n"))
    beliefs = dict(zip(zip(kind.tolist(), vote.tolist(), strict=True), aggregate(kind, vote, count).tolist(), strict=True))
    named = {(KINDS[k], v): belief for (k, v), belief in beliefs.items()}
    total, steps = int(cast["rows"].sum()), 1 << 40
    if not total:
        return Model(None, named)
    if total > rows:
        found = found.filter(F.pmod(F.xxhash64("kind", "votes", "features"), F.lit(steps)) < int(steps * rows / total))
    taken = found.orderBy("kind", "votes", "features").toArrow()  # about ``rows`` rows of some thirty numbers
    values, ends = taken["features"].combine_chunks().flatten().to_numpy(), taken["features"].combine_chunks().value_lengths().to_numpy().cumsum()
    held = np.split(values, ends[:-1]) if len(ends) else []
    goal = np.array([beliefs[k, v] for k, v in zip(taken["kind"].to_pylist(), taken["votes"].to_pylist(), strict=True)])
    if not held:
        return Model(None, named)
    weight = 1 + np.log(taken["n"].to_numpy())  # a span copied a million times is no million examples
    return Model(fit_classifier(held, goal, weight), named)


SPANS = "array<struct<kind:string,start:bigint,end:bigint,probability:double>>"


def text_spans(text: str, model: Model, limit: float = LIMIT) -> list[dict]:
    """Spans of one text by start, then as `KINDS` lists them."""
    base = base_spans(text)
    found = []
    for span in base + added_candidates(text, base):
        chance = model.probability(features(_seen(text, span)))
        if span[0] in BASE or chance >= limit:
            found.append(dict(zip(("kind", "start", "end"), span, strict=True), probability=chance))
    return sorted(found, key=lambda span: (span["start"], KINDS.index(span["kind"])))


def with_spans(docs: DataFrame, model: Model, spans: str, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """``docs`` with the array column ``spans``: kind, place and the classifier's probability of each."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, T.DataType.fromDDL(SPANS))])
    names = [field.name for field in schema.fields]
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_spans(value or "", model, limit) for value in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=names)

    return wd.mapped(docs, run, schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, model: Model, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; of spans that overlap the first."""
    at, names = docs.columns.index(text), docs.columns

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        out, last = [], 0
        for span in text_spans(value, model, limit):
            if span["start"] >= last:
                out += [value[last : span["start"]], f"<{span['kind']}>"]
                last = span["end"]
        return "".join([*out, value[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array([one(value) for value in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return wd.mapped(docs, run, docs.schema)
