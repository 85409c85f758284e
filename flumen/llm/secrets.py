"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two second-order models over the characters of a token are trained from labelled samples:

 - random strings: the values that the fixed patterns find, by the alphabet they are made of (lower-case hexadecimal,
   letters and digits, ...). Each alphabet has a chain of its own, which starts as uniform over the alphabet and moves
   towards the transitions counted; alphabets weigh as often as they were met.
 - ordinary identifiers: the words and names of three characters and more that no pattern touches. One chain has the
   order of upper case, lower case, digits and marks, another the letters, without case, of each word that a name is
   made of (a word starts after anything but a letter and where upper case follows lower case).

Names outside the corpus are made of other words and in other styles than those that a sample shows. So both chains of
the ordinary model keep a fixed part for what they weren't shown: half of the styles' weight goes to STYLES, a table of
how names are written, and of a letter's weight OPEN goes to single letters in place of pairs and triples of them.

Both learn from each different token once, so that copies of a text add nothing; transitions that a single name has don't
count, as it may be a secret that nothing labels.

A token that touches no base span and has a letter is a span of its own if the log-likelihood ratio of the models is
at least THRESHOLD, and EACH for each of its characters, so that one odd word in a long name isn't enough. Counts of higher order are drawn towards those of lower order, so that a small sample makes the
models vague and nothing else: without any labelled value the random strings' model is the uniform one, and without any
ordinary word the other one has the styles alone, with any letter as likely as another.

Training reads all texts for the number of those in which a pattern may match and of all others, then a sample of at
most about SAMPLE different texts of each kind, chosen by a hash of the text; two count tables of a size that the
alphabet fixes go to the driver. Scanning reads every text whole, in time that grows with its length. Null texts count
as empty; other columns are ignored; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 and more are the runs of one and more that are long enough
KINDS = ("assign", "access", "hex", "markov")
#: Java pattern of texts in which one of these may match.
QUICK = r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{32}"

#: What the models judge: tokens of some length.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
#: What ordinary identifiers are learnt from.
NAME = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
#: Texts read for training, at most about, of those in which a pattern may match and of the others.
SAMPLE = 10_000
#: Log-likelihood ratio from which a token counts as random.
THRESHOLD = 8.0
#: Log-likelihood ratio a character that it has as well.
EACH = 0.2
#: Weight of the order below in counts of transitions.
DRAWN = 20.0
#: Parts of a letter's likelihood that are its own without those before it, and the same for all letters.
OPEN, ANY = 0.3, 0.1
#: Length of the tokens that the models can tell apart is not bounded; values are cut into parts of so many characters.
PART = 1 << 16

MARKS = "+/_=-."
CHARACTERS = string.ascii_lowercase + string.ascii_uppercase + string.digits + MARKS
#: The last state: start of a token, or another character.
EDGE = len(CHARACTERS)
SIZE = EDGE + 1
CODE = np.full(128, EDGE, np.uint8)
CODE[[ord(c) for c in CHARACTERS]] = range(EDGE)
#: Letters without case, and what kind a character is: lower, upper, digit, mark, edge.
FOLD = np.array([*range(26), *range(26), *range(52, SIZE)])
SHAPE = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3] * len(MARKS) + [4])
#: How names are written, whatever the corpus shows: what kind comes after each kind (lower, upper, digit, mark, start).
STYLES = np.array([[0.90, 0.04, 0.01, 0.05], [0.33, 0.60, 0.01, 0.06], [0.08, 0.04, 0.60, 0.28], [0.50, 0.25, 0.10, 0.15], [0.60, 0.30, 0.05, 0.05]])
#: Alphabets of random strings, each in the order of what it adds; a value belongs to the first that holds it.
ALPHABETS = [
    string.digits + "abcdef", string.digits + "ABCDEF", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase,
    string.digits + string.ascii_letters, string.digits + string.ascii_letters + "-_", string.digits + string.ascii_letters + "+/=", CHARACTERS,
]
WITHIN = np.array([[c in a for c in CHARACTERS] + [False] for a in ALPHABETS])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) as fixed by the patterns, in order; matches of a kind don't overlap."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _codes(token: str) -> np.ndarray:
    return CODE[np.frombuffer(token.encode("ascii"), np.uint8)]


def _plain(pattern: re.Pattern, text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Matches that touch no span. Both are in order, so one look at each is enough; spans may overlap each other."""
    at, reach = 0, 0
    for m in pattern.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            yield m.start(), m.end()


def _before(codes: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The second and first character before each."""
    padded = np.concatenate(([edge, edge], codes))
    return padded[:-2], padded[1:-1]


def _within_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each letter without case and the two before it in its word; the edge where the word hasn't so many. Digits and
    marks stand alone."""
    shape, folded = SHAPE[codes], FOLD[codes]
    letter = shape < 2
    goes_on = np.zeros(len(codes), bool)
    goes_on[1:] = letter[1:] & letter[:-1] & ~((shape[1:] == 1) & (shape[:-1] == 0))
    b, a = np.full(len(codes), EDGE), np.full(len(codes), EDGE)
    b[1:] = np.where(goes_on[1:], folded[:-1], EDGE)
    a[2:] = np.where(goes_on[2:] & goes_on[1:-1], folded[:-2], EDGE)
    return a, b, folded


def alphabet_of(codes: np.ndarray) -> int:
    return int(WITHIN[:, np.unique(codes)].all(1).argmax())


#: Labels of what is counted: an alphabet's transitions, those of letters within words, those of shapes.
FOLDED, SHAPES = len(ALPHABETS), len(ALPHABETS) + 1


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different tokens of each text: labelled ones (is_value) and ordinary ones."""
    for frame in frames:
        rows = []
        for text in frame["text"]:
            spans = base_spans(text)
            values = {m.group(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8} | {text[s:e] for s, k, e in spans if k}
            rows += [(True, x) for x in values]
            rows += [(False, x) for x in {text[s:e] for s, e in _plain(NAME, text, spans)}]
        yield pd.DataFrame(rows, columns=["is_value", "token"])


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Transitions of different tokens."""
    counts = np.zeros((len(ALPHABETS) + 2) * SIZE**3, np.int64)
    place = lambda label, a, b, c: ((label * SIZE + a.astype(np.int64)) * SIZE + b) * SIZE + c
    for frame in frames:
        for value in frame["token"][frame["is_value"]]:
            c = _codes(value)
            np.add.at(counts, place(alphabet_of(c), *_before(c, EDGE), c), 1)
        names = frame["token"][~frame["is_value"]].tolist()
        if names:
            # All names in a row, each with two edges before it.
            c = _codes("\n\n" + "\n\n".join(names))
            inside = np.flatnonzero(c[2:] != EDGE) + 2
            x = SHAPE[c]
            for label, (a, b, of) in ((FOLDED, (k[inside] for k in _within_words(c))), (SHAPES, (x[inside - 2], x[inside - 1], x[inside]))):
                at, n = np.unique(place(label, a, b, of), return_counts=True)
                counts[at] += n
    at = counts.nonzero()[0]
    label, a, b, c = np.unravel_index(at, (len(ALPHABETS) + 2, SIZE, SIZE, SIZE))
    yield pd.DataFrame({"label": label, "a": a, "b": b, "c": c, "n": counts[at]})


def _alone(counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How likely each character is by itself; start is what it is without counts."""
    one = counts.sum((0, 1))
    return (one + DRAWN * start) / (one.sum() + DRAWN)


def _chain(counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Likelihood of each transition (a, b, c), from counts; start is what c is without any."""
    p = _alone(counts, start)
    two = counts.sum(0)
    p = (two + DRAWN * p) / (two.sum(1, keepdims=True) + DRAWN)
    return (counts + DRAWN * p) / (counts.sum(2, keepdims=True) + DRAWN)


class Models:
    """The two models, as tables of log-likelihoods, in single precision."""

    def __init__(self, counts: np.ndarray) -> None:
        starts = WITHIN / WITHIN.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.random = np.array([np.log(_chain(counts[i], starts[i])) for i in range(len(ALPHABETS))], np.float32)
        met = counts[: len(ALPHABETS)].sum((1, 2, 3)) + 1.0
        self.weight = np.log(met / met.sum())
        self.letters = np.log(self._letters(counts[FOLDED])).astype(np.float32)
        n = int(SHAPE.max()) + 1
        shown = counts[SHAPES, :n, :n, : n - 1]
        shown = (shown + DRAWN * STYLES) / (shown.sum(2, keepdims=True) + DRAWN)
        self.shapes = np.log((STYLES + shown) / 2).astype(np.float32)

    @staticmethod
    def _letters(counts: np.ndarray) -> np.ndarray:
        """Likelihood of a character, given its kind: letters by those before them, a digit and a mark by themselves."""
        p = np.zeros((SIZE, SIZE, SIZE))
        for kind in (SHAPE == 0, SHAPE == 2, SHAPE == 3):
            start, own = kind / kind.sum(), counts * kind
            if kind[0]:
                p += (1 - OPEN - ANY) * _chain(own, start) + OPEN * _alone(own, start) + ANY * start
            else:
                p += _alone(own, start) if kind[-2] else start
        # A letter that stands twice is as often as not one of a row, as in placeholders and rulers.
        twice = np.flatnonzero(SHAPE == 0)
        p[twice, twice] /= 2
        p[twice, twice, twice] += 0.5
        return np.maximum(p, np.finfo(np.float32).tiny)

    def ratio(self, token: str) -> float:
        """How much better the token is explained as a random string than as an ordinary identifier, in nats."""
        c = _codes(token)
        random = self.weight.copy()
        possible = np.flatnonzero(WITHIN[:, np.unique(c)].all(1))
        a, b = _before(c, EDGE)
        for at in range(0, len(c), PART):
            s = slice(at, at + PART)
            random[possible] += self.random[possible[:, None], a[s], b[s], c[s]].sum(1, dtype=np.float64)
        ordinary = float(self.letters[_within_words(c)].sum(dtype=np.float64)) + float(self.shapes[SHAPE[a], SHAPE[b], SHAPE[c]].sum(dtype=np.float64))
        return float(np.logaddexp.reduce(random[possible]) - ordinary)

    def is_random(self, token: str, threshold: float = THRESHOLD) -> bool:
        return self.ratio(token) >= max(threshold, EACH * len(token))


def train(docs: DataFrame, sample: int = SAMPLE) -> Models:
    key = F.xxhash64("text")
    keyed = texts(docs).select("text", key.alias("key"), F.col("text").rlike(QUICK).alias("may"))
    found = {r["may"]: r["n"] for r in keyed.groupBy("may").agg(F.approx_count_distinct("key").alias("n")).collect()}
    bound = lambda may: int((1 << 62) * min(1.0, sample / max(found.get(may, 0), 1)))
    some = keyed.filter(F.col("key").bitwiseAND(F.lit((1 << 62) - 1)) <= F.when(F.col("may"), bound(True)).otherwise(bound(False)))
    once = some.groupBy("key").agg(F.first("text").alias("text"))
    tokens = once.select("text").mapInPandas(_tokens, "is_value boolean, token string").distinct()
    counts = np.zeros((len(ALPHABETS) + 2, SIZE, SIZE, SIZE))
    for r in tokens.mapInPandas(_count, "label int, a int, b int, c int, n long").groupBy("label", "a", "b", "c").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["label"], r["a"], r["b"], r["c"]] = r["n"]
    # What a single name has counts as not seen: a secret that nothing labels is in the sample as well.
    counts[FOLDED] = np.maximum(counts[FOLDED] - 1, 0)
    return Models(counts)


def scan(docs: DataFrame, models: Models, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end in code points, by start, then kind)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            n, base, every = [], [], []
            for text in b.column("text").to_pylist():
                spans = base_spans(text)
                more = []
                for s, e in _plain(TOKEN, text, spans):
                    token = text[s:e]
                    if any(x.isalpha() for x in token) and known.is_random(token, threshold):
                        more.append((s, 3, e))
                join = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
                kinds = [k for _, k, _ in spans]
                n.append([kinds.count(k) for k in range(3)])
                base.append(hashlib.sha256(join(spans).encode()).hexdigest())
                every.append(join(sorted(spans + more)))
            cols = np.array(n, np.int64).reshape(-1, 3)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(cols[:, i]) for i in range(3)), pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def find_secrets(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    return scan(docs, train(docs, sample), threshold)
