"""Personal data by weak supervision (operator 10).

Four base kinds (email, ip, card, phone) are exact patterns with checks.  The
method adds further spans.  Candidates are, beside the base spans, words that hold a digit, ``@`` or ``=``,
and runs of capitalised words with a house number before or after them.
Thirteen labelers vote on a candidate, for, against or not at all: regex (masses of
digits, signs, mixed tokens, list numbers, markup, a check digit), gazetteers (names,
titles, streets and places, function words) and context (keys and cue words before it).
They disagree often, so expectation-maximisation over the counts of vote
patterns, which Spark gathers from all rows, estimates how reliable each one
is.  Base spans are facts and count as personal; all else only starts from its
votes, softly, and a weak prior says which class is which.  A logistic span classifier over the
candidate's features is trained on the resulting probabilities and decides.
Only tables of patterns reach the driver: their size is bounded by the number
of labelers and features, not by the data.

Edge cases: null and empty texts have no spans; without candidates nothing is
added; a word or run that overlaps a base span is no candidate; positions are code
points, the end is exclusive; equal texts, also in repeated rows, have equal
spans; texts are scanned in time linear in their length; an empty table gives no
rows; only the text is read, so other columns may carry any name.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret", "name", "address", "personal")
SECRET, NAME, ADDRESS, OTHER = 4, 5, 6, 7
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: what stands before it is no digit.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A capitalised word, or a short one with its dot (a title or an initial); runs of them, or one with a number after it.
_UPPER = r"[A-Z\u00c0-\u00de]"
_REST = r"(?:[^\W\d_]{0,3}+\.|(?:[^\W\d_]|['\u2019-])++(?![\w@=]))"
RUN = re.compile(rf"{_UPPER}(?<![\w'\u2019-]{_UPPER}){_REST}(?:(?:\x20{_UPPER}{_REST})++(?:\x20[0-9]{{1,5}}(?![\w.@=]))?|\x20[0-9]{{1,5}}(?![\w.@=]))")
HOUSE = re.compile(r"(?<!\S)[0-9]{1,5}[A-Za-z]?\x20$")
MARK, WORD_END = re.compile(r"[0-9@]|=(?=\S)"), re.compile(r"\S*+")
#: Gazetteers and cues: our own choice of common words in the corpus' languages.
GIVEN = frozenset("""james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony
betty steven margaret andrew emily hans peter wolfgang ursula klaus monika juergen sabine dieter renate jean marie pierre jeanne michel catherine alain nathalie philippe isabelle jose maria antonio
carmen manuel josefa francisco isabel juan dolores anna sofia lukas paul""".split())
FAMILY = frozenset("""smith johnson williams brown jones miller davis wilson anderson taylor moore jackson thompson harris clark lewis robinson walker mueller schmidt schneider fischer weber meyer
wagner becker schulz hoffmann martin bernard dubois durand leroy moreau laurent lefebvre garcia rodriguez gonzalez fernandez lopez martinez sanchez perez gomez""".split())
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame mme mlle sr sra senor senora".split())
STREETS = frozenset("street st road rd avenue ave lane drive boulevard blvd court square strasse straße gasse weg platz allee rue place chemin quai calle avenida plaza paseo camino".split())
STREET_ENDS = ("strasse", "straße", "gasse", "weg", "platz", "allee")
PLACES = frozenset("london paris berlin madrid hamburg munich vienna zurich lyon marseille barcelona sevilla valencia boston chicago denver seattle dallas houston toronto geneva brussels".split())
FUNCTION = frozenset("""the and for with this that from version license chapter figure table section page part der die das und ein eine von mit kapitel seite teil les des une dans pour avec chapitre
los las una por con para capitulo""".split())
CUES = frozenset("mail email e-mail contact call phone tel telephone mobile fax reach card account iban visa password passwd pwd login user username token secret key ssn id address ip host name named lives born".split())
KEYS = re.compile(r"(?i)^\W*(password|passwd|pwd|secret|token|api[_-]?key|key|ssn|iban|login|user(name)?|auth)[=:]\S")
KEY_BEFORE = re.compile(r"(?i)(password|passwd|pwd|secret|token|key|ssn|iban|login|auth)\s{0,3}[=:]\s{0,3}\W?$")
LISTED = re.compile(r"^\W*\d{1,3}([.:)]\d{0,3})*\W*$")
MARKUP = re.compile(r"://|[<>{}|\\]|^=+$|^#")
LABELERS = ("digits", "sign", "key", "cue", "mixed", "names", "titles", "places", "in no list", "listed", "markup", "check digit", "function words")
FEATURES = 16
RUN_BIT, NUMBER_BIT = 14, 15


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(part: str) -> bool:
    """A number of at most 255; leading zeros, however many, do not count."""
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order; kind is an index into KINDS."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            free = match.end()
        else:
            free = max(free, at)  # a local part never holds the sign itself
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(found)


def _apart(spans: Iterator[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of ``spans`` that overlap none of ``taken``; both in order."""
    k, reach = 0, 0
    for start, end in spans:
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= start:
            yield start, end


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of capitalised words, with a house number before them."""
    for m in RUN.finditer(text):
        house = HOUSE.search(text, max(0, m.start() - 8), m.start())
        yield house.start() if house else m.start(), m.end()


def _marked(text: str) -> Iterator[tuple[int, int]]:
    """Words that hold a digit, ``@`` or ``=`` before more."""
    end = 0
    while mark := MARK.search(text, end):
        start = mark.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = WORD_END.match(text, mark.start()).end()
        yield start, end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[int, ...], int, bool]]:
    """(start, end, votes, features, is a base span): the base spans, and runs and words that overlap none."""
    taken = [(a, b) for a, _, b in base]
    runs = list(_apart(_runs(text), taken))
    words = _apart(_marked(text), sorted(taken + runs))
    rows = [*((a, b, k, False) for a, k, b in base), *((a, b, None, True) for a, b in runs), *((a, b, None, False) for a, b in words)]
    out = []
    for start, end, kind, run in rows:
        word = text[start:end]
        digits = sum(c.isdigit() for c in word)
        letters = sum(c.isalpha() for c in word)
        near = text[max(0, start - 40) : start]
        parts = [w.strip(".,;:!?()\"'") for w in word.lower().split(" ")] if run else []
        named = any(w in GIVEN or w in FAMILY for w in parts)
        titled = any(w in TITLES for w in parts[:-1])
        placed = digits > 0 and any(w in STREETS or w.endswith(STREET_ENDS) for w in parts) or any(w in PLACES for w in parts)
        key = bool(KEYS.search(word) or KEY_BEFORE.search(near))
        cue = any(w.strip(".,;:!?()=") in CUES for w in near.lower().split()[-3:])
        mixed = kind is None and not run and letters >= 2 and len(word) >= 12 and digits >= (1 if word.isupper() else 2)
        check = 0
        if not run and 13 <= digits <= 19 and not letters:
            check = 1 if luhn("".join(c for c in word if c in "0123456789")) else -1
        votes = (
            0 if run else 1 if digits >= 7 else -1 if digits <= 4 and len(word) < 12 and "@" not in word and "=" not in word else 0,
            int("@" in word),
            int(key),
            int(cue),
            int(mixed),
            int(named),
            int(titled),
            int(placed),
            -int(run and not (named or titled or placed)),
            -int(bool(LISTED.match(word))),
            -int(bool(MARKUP.search(word))),
            check,
            -int(any(w in FUNCTION for w in parts)),
        )
        bits = ("@" in word, "=" in word, digits >= 4, digits >= 10, letters >= 4, len(word) >= 12, "." in word.strip("."), word[0].isdigit(), letters == 0, check > 0, cue, key, named or titled, placed, run, digits > 0)
        out.append((start, end, votes, sum(int(b) << i for i, b in enumerate(bits)), kind is not None))
    return out


def _bits(shape: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(shape)), *((shape >> i & 1) for i in range(FEATURES))]).astype(float)


def sort_of(shape: np.ndarray) -> np.ndarray:
    """0 for words, 1 for runs of capitalised words, 2 for such with a number."""
    return (shape >> RUN_BIT & 1) * (1 + (shape >> NUMBER_BIT & 1))


#: P(against, none, for) of a labeler before any row is seen, for other text and for personal data: better than chance, no more.
BELIEF = np.array([[0.3, 0.6, 0.1], [0.1, 0.6, 0.3]])


def first_guess(votes: np.ndarray) -> np.ndarray:
    """P(personal | pattern) that expectation-maximisation starts from: the share of votes for, drawn to one in four."""
    return (0.25 + (votes > 0).sum(axis=1)) / (1 + (votes != 0).sum(axis=1))


def reliabilities(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: P(vote | class) [labeler, class, vote + 1], and P(personal | pattern).

    Patterns of ``known`` rows stay personal.  The prior weighs one row in twenty, so the data may find a labeler worse than chance and turn its votes round.
    """
    total = counts.sum()
    weight, p = 2 + 0.05 * total, np.where(known, 1.0, first_guess(votes))
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        share = ((counts * p).sum() + 0.25 * weight) / (total + weight)
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                same = votes[:, j] == v
                table[j, 1, v + 1] = (counts * p)[same].sum() + weight * BELIEF[1, v + 1]
                table[j, 0, v + 1] = (counts * (1 - p))[same].sum() + weight * BELIEF[0, v + 1]
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(table)
        odds = np.log(share / (1 - share)) + sum(logs[j, 1, votes[:, j] + 1] - logs[j, 0, votes[:, j] + 1] for j in range(votes.shape[1]))
        new = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -40, 40))))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return table, p


@dataclass
class Model:
    #: P(vote | class) [words, runs, runs with a number][labeler][class][vote + 1]
    reliability: list = field(default_factory=list)
    #: Of the classifier, over 1 and the features.
    curve: tuple[float, ...] = ()

    def personal(self) -> bytes:
        """Decision (0 or 1) for each combination of features."""
        if not self.curve:
            return bytes(1 << FEATURES)
        return (_bits(np.arange(1 << FEATURES)) @ np.array(self.curve) > 0).astype(np.uint8).tobytes()


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Reliabilities and classifier from all rows of ``docs``; without candidates a model that adds nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("t").to_pylist():
                seen.update(c[2:] for c in candidates(text, base_spans(text)))
        yield pa.RecordBatch.from_arrays([pa.array([list(k[0]) for k in seen], pa.list_(pa.int32())), pa.array([k[1] for k in seen], pa.int32()), pa.array([k[2] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["votes", "shape", "known", "n"])

    texts = docs.select(text_or_empty(text_col).alias("t")).where("t <> ''")
    # As many rows as combinations of answers and features occur: bounded by their number, whatever the data.
    seen = texts.mapInArrow(count, "votes array<int>, shape int, known boolean, n long").groupBy("votes", "shape", "known").agg(F.sum("n").alias("n")).toPandas().sort_values(["shape", "votes", "known"], key=lambda c: c.map(str))
    if seen.empty:
        return Model()
    votes, counts, shape, known = np.array(seen.votes.tolist(), dtype=int), seen.n.to_numpy(float), seen["shape"].to_numpy(int), seen.known.to_numpy(bool)
    # Words, runs and runs with a number are different questions: no labeler is equally good at all.
    sort, p, table = sort_of(shape), np.zeros(len(counts)), []
    for kind in range(3):
        own = sort == kind
        if own.any():
            found, p[own] = reliabilities(votes[own], counts[own], known[own])
        table.append(found.tolist() if own.any() else [])
    x, w = _bits(shape), np.zeros(FEATURES + 1)
    ridge = np.diag([1e-3] + [0.5] * FEATURES)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (counts * (p - q)) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return Model(table, tuple(float(v) for v in w))


def _kind(features: int, word: str) -> int:
    """Which of the added kinds a candidate is, by the last features."""
    if features >> 13 & 1:
        return ADDRESS
    if features >> 14 & 1:
        return NAME
    return SECRET if features >> 11 & 1 or "=" in word or features >> 4 & features >> 5 & 1 and "@" not in word else OTHER


def all_spans(text: str, personal: bytes) -> tuple[list, list]:
    """Base spans, and all spans: what the classifier accepts joins them."""
    base = base_spans(text)
    added = [(a, _kind(shape, text[a:b]), b) for a, b, _, shape, known in candidates(text, base) if personal[shape] and not known]
    return base, sorted(base + added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def spans_of(model: Model, text: Column) -> Column:
    """Struct of counts by base kind, the digest of base spans, and all spans."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        personal = model.personal()
        for texts in batches:
            rows = []
            for t in texts:
                base, every = all_spans(t, personal)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return find(F.coalesce(text.cast("string"), F.lit("")))


def redacted(model: Model, text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        personal = model.personal()
        for texts in batches:
            out = []
            for t in texts:
                at, parts = 0, []
                for a, k, b in all_spans(t, personal)[1]:
                    if a >= at:
                        parts += [t[at:a], f"[{KINDS[k].upper()}]"]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]))
            yield pd.Series(out)

    return F.when(text.isNotNull(), mask(F.coalesce(text.cast("string"), F.lit(""))))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return docs.select("doc_id", spans_of(model, F.col("text")).alias("s")).select("doc_id", "s.*")
