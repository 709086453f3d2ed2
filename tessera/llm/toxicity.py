"""Toxicity by a weighted lexicon.

Texts are lower-cased and folded (look-alike letters of other scripts, full-width forms, and digits or signs that
stand for letters within a word), then searched for all lexicon entries at once by Aho-Corasick. An entry is a whole
word or a stem (a word's beginning); a hit inside an exception phrase doesn't count. The weights of the hits are
summed and normalised by length, and a logistic curve maps that to a score.

The lexicon, the exception phrases and the curve are learned from labelled rows: an entry's weight is the log-odds
of its occurring in toxic over other documents, and words that begin with an entry but are no likelier in toxic
documents become exceptions.

Defined cases: null, empty and clean texts score alike, below 0.5, as no entry hits; ties between entries go to the
shorter, then by code point; repeated rows are scored alike; an empty table gives an empty result; without toxic
training rows the lexicon is empty; extra columns are ignored; texts are read whole, however long.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, crc_bucket, documents, labels, short_batches

#: The lexicon is fitted on about so many labelled rows at most (the documented bound of the fitting sample).
FIT_ROWS = 12_000
THRESHOLD = 0.7
#: An entry is learned if so many toxic documents have it, its log-odds are so high, and its log-likelihood ratio
#: exceeds what the best of all candidates would reach by chance by so much.
LEAST_DOCS, LEAST_WEIGHT, LEAST_EVIDENCE = 4, 1.8, 4.0
#: A stem is learned if it begins so many different words.
LEAST_FORMS = 5
STEMS = (3, 4, 5, 6, 7, 8, 9)

#: Letters of other scripts that look like Latin ones, and signs and digits used in their place (fixed values).
HOMOGLYPHS = dict(zip("аеорсухіјѕԁԛԝһԍӏвкмнтαεορτυικνχηωβ", "aeopcyxijsdqwhglbkmhtaeoptuikvxnwb", strict=True))
DIGITS = dict(zip("013457@$", "oieastas", strict=True))

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
_UNLEET = str.maketrans(DIGITS)


def fold(text: str) -> str:
    """Lower case, look-alikes to Latin, and digits or signs between letters to the letters they stand for."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if any(c in text for c in _PRESENT):
            # Only words that mix scripts are disguised: a word wholly in Greek or Cyrillic stays.
            text = _MIXED.sub(lambda m: m[0].translate(_FOLD) if _LATIN.search(m[0]) or _WIDE.search(m[0]) else m[0], text)
    return _LEET.sub(lambda m: m[0].translate(_UNLEET), text)


_PRESENT = "".join(HOMOGLYPHS) + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_MIXED = re.compile(rf"[^\s]*[{re.escape(_PRESENT)}][^\s]*")
_LATIN, _WIDE = re.compile("[a-z]"), re.compile("[！-～]")
_LEET = re.compile(r"[013457@$](?=[^\W\d_])|(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])")
#: fold() may leave a word disguised that has a digit or sign beside a letter, or a look-alike. Both are linear in long words.
_TOKEN = re.compile(r"(?:[^\W_]++|[@$]++)++")
_DISGUISED = re.compile(rf"[^\W\d_][013457@$]|[013457@$][^\W\d_]|[{re.escape(_PRESENT)}]")
_ONES = [_UNLEET | {ord("1"): one} for one in "il"]
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    #: Of the three measures of weigh(), and a constant.
    curve: list[float] = field(default_factory=lambda: [1.0, 1.0, 0.0, -3.0])

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures @ np.array(self.curve[:3]) + self.curve[3], -500, 500)))

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for kind, named in (("word", self.words), ("stem", self.stems), ("not", dict.fromkeys(self.exceptions, 0.0))):
            for entry, weight in named.items():
                entries.setdefault(entry, []).append((kind, len(entry), weight))
        for entry, found in entries.items():
            a.add_word(entry, found)
        a.make_automaton()
        return a if len(a) else None


def weigh(text: str | None, automaton) -> tuple[float, float, float]:
    """Logarithms of the weight of all hits and of that per hundred words, and the heaviest hit."""
    if not text or automaton is None:
        return 0.0, 0.0, 0.0
    folded = fold(text)
    hits = _hits(folded, automaton) + _disguised_hits(text, automaton)
    if not hits:
        return 0.0, 0.0, 0.0
    best: dict[int, float] = {}  # a word counts once, by its heaviest entry
    for start, _, weight in hits:
        best[start] = max(best.get(start, 0.0), weight)
    total = sum(best.values())
    return math.log1p(total), math.log1p(total * 100 / (100 + len(folded) / 6)), max(best.values())


def _hits(folded: str, automaton) -> list[tuple]:
    """(start, end, weight) of each entry in a folded text that no exception phrase covers."""
    hits, spared = [], []
    for end, found in automaton.iter(folded):
        for kind, size, weight in found:
            start = end - size + 1
            if start and folded[start - 1].isalpha():
                continue
            if (end + 1 < len(folded) and folded[end + 1].isalpha()) != (kind == "stem"):
                continue
            (spared if kind == "not" else hits).append((start, end, weight))
    return _outside(hits, spared) if spared and hits else hits


def _disguised_hits(text: str, automaton) -> list[tuple]:
    """Hits of words as they read with look-alikes and signs folded wherever they are, and 1 as i or l.

    Folding keeps lengths, so a hit's start is that in the folded text. A word without a Latin letter of its own may
    be a word of its script: it has to be an entry as a whole.
    """
    out = []
    low = unicodedata.normalize("NFC", text.lower())
    if not _DISGUISED.search(low):
        return out
    for m in _TOKEN.finditer(low):
        if not _DISGUISED.search(m[0]):
            continue
        plain, own = m[0].translate(_FOLD), _LATIN.search(m[0])
        for word in {plain.translate(one) for one in _ONES}:
            if word.isascii() and word.isalpha():
                out += [(m.start(), m.start() + end, weight) for start, end, weight in _hits(word, automaton) if start == 0 and (own or end == len(word) - 1)]
    return out


def _outside(hits: list[tuple], spared: list[tuple]) -> list[tuple]:
    """Hits that no exception phrase covers: one pass over both, sorted by start."""
    out, i, reach = [], 0, -1
    spared = sorted(spared)
    for h in sorted(hits):
        while i < len(spared) and spared[i][0] <= h[0]:
            reach = max(reach, spared[i][1])
            i += 1
        if h[1] > reach:
            out.append(h)
    return out


def _evidence(hits: int, docs: int, other_hits: int, other_docs: int) -> float:
    """The log-likelihood ratio for a higher rate in docs than in the others; 0 if it is no higher."""
    rate = (hits + other_hits) / (docs + other_docs)
    if hits / docs <= rate:
        return 0.0
    part = lambda k, n: k * math.log(k / n / rate) if k else 0.0
    return 2 * (part(hits, docs) + part(other_hits, other_docs))


def learn(rows: list[tuple[str | None, int]]) -> Lexicon:
    """A lexicon from (text, toxic) rows."""
    words = {0: Counter(), 1: Counter()}
    stems = {0: Counter(), 1: Counter()}
    toxic = [bool(y) for _, y in rows]
    texts = [fold(t or "") for t, _ in rows]
    n = {1: sum(toxic), 0: len(toxic) - sum(toxic)}
    out = Lexicon()
    if not n[1] or not n[0]:
        return out
    for y, text in zip(toxic, texts, strict=True):
        found = set(_WORD.findall(text))
        words[y].update(found)
        if y:
            stems[1].update({w[:k] for w in found for k in STEMS if len(w) > k})
    likely = {s for s, c in stems[1].items() if c >= LEAST_DOCS}
    known: dict[str, tuple[str, ...]] = {}
    for y, text in zip(toxic, texts, strict=True):
        if not y:
            found = set(_WORD.findall(text))
            stems[0].update({s for w in found for s in (known[w] if w in known else known.setdefault(w, tuple(w[:k] for k in STEMS if len(w) > k and w[:k] in likely)))})

    def odds(x: str, df: dict[int, Counter]) -> float:
        return math.log((df[1][x] + 0.5) / (n[1] + 1)) - math.log((df[0][x] + 0.5) / (n[0] + 1))

    def telling(x: str, df: dict[int, Counter]) -> bool:
        return df[1][x] >= LEAST_DOCS and odds(x, df) >= LEAST_WEIGHT and _evidence(df[1][x], n[1], df[0][x], n[0]) >= least

    least = LEAST_EVIDENCE + 2 * math.log(1 + sum(c >= LEAST_DOCS for df in (words, stems) for c in df[1].values()))

    told_words, told_stems = ({x for x in df[1] if telling(x, df)} for df in (words, stems))
    # Copies of one text aren't evidence anew: an entry must be told by as many neighbourhoods of words as of documents.
    around: dict[str, set] = {}
    for y, text in zip(toxic, texts, strict=True):
        if y:
            run = _WORD.findall(text)
            for i, w in enumerate(run):
                for x in [("w", w)] * (w in told_words) + [("s", w[:k]) for k in STEMS if len(w) > k and w[:k] in told_stems]:
                    around.setdefault(x, set()).add((*run[max(0, i - 3) : i], "", *run[i + 1 : i + 4]))
    enough = lambda kind, x, df: len(around.get((kind, x), ())) >= max(LEAST_DOCS, df[1][x] / 3)
    told_words = {x for x in told_words if enough("w", x, words)}
    told_stems = {x for x in told_stems if enough("s", x, stems)}
    forms = Counter(w[:k] for w in words[1] for k in STEMS if len(w) >= k)
    strength = {s: _evidence(stems[1][s], n[1], stems[0][s], n[0]) for s in told_stems}
    # What says as much and is purer goes before a stem that merely contains it.
    purer: dict[str, float] = {}
    for x, df in [(w, words) for w in told_words] + [(t, stems) for t in told_stems]:
        o = odds(x, df)
        for k in STEMS:
            if k < len(x) and x[:k] in strength and df[1][x] >= 0.7 * stems[1][x[:k]]:
                purer[x[:k]] = max(purer.get(x[:k], 0.0), o)
    told_stems = {s for s in told_stems if odds(s, stems) > purer.get(s, 0.0) - 1}
    taken: set[str] = set()  # beginnings of stems that are in
    for s in sorted(told_stems, key=lambda s: (-strength[s], len(s), s)):
        if forms[s] >= LEAST_FORMS and s not in taken and not any(s[:k] in out.stems for k in STEMS if k < len(s)):
            out.stems[s] = odds(s, stems)
            taken.update(s[:k] for k in STEMS if k < len(s))
    covered = lambda w: any(w[:k] in out.stems for k in STEMS if k <= len(w))
    out.words = {w: odds(w, words) for w in sorted(told_words) if not covered(w)}
    out.exceptions = sorted(w for w, c in words[0].items() if c >= LEAST_DOCS and covered(w) and odds(w, words) <= 0)
    automaton = out.automaton()
    out.curve = _logistic(np.array([weigh(t, automaton) for t, _ in rows]), np.array(toxic, float))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Coefficients (none below 0) and constant of a lightly damped logistic curve, by Newton's steps."""
    use, w = [0, 1, 2], np.zeros(4)
    while use:
        a, w = np.concatenate([x[:, use], np.ones((len(x), 1))], 1), np.zeros(len(use) + 1)
        damp = np.diag([0.02] * len(use) + [1e-3])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w = w - np.clip(np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + damp, a.T @ (p - y) + damp @ w), -2, 2)
        if (w[:-1] >= 0).all():
            break
        use.pop(int(np.argmin(w[:-1])))
    out = [0.0, 0.0, 0.0, float(w[-1])]
    for j, v in zip(use, w, strict=False):
        out[j] = float(v)
    return out


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted added."""
    short_batches(docs.sparkSession)

    def run(series: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in series:
            score = lexicon.score(np.array([weigh(t, automaton) for t in b.column(1).to_pylist()]).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, unchanged, that score under the threshold."""
    short_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(series: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in series:
            score = lexicon.score(np.array([weigh(t, automaton) for t in b.column(at).to_pylist()]).reshape(-1, 3))
            yield b.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, marks: DataFrame, at_most: int = FIT_ROWS) -> Lexicon:
    """Learn from about at_most rows of marks (doc_id, toxic), joined to their texts."""
    marks = marks.select(F.col("doc_id").cast("long"), "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    sample = bounded(marks, F.col("doc_id"), at_most, marks.count())
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    return learn_on_executors(rows)


def learn_on_executors(rows: DataFrame) -> Lexicon:
    """learn() over the bounded sample in one task, so that its texts never reach the driver."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        x = learn(sorted(seen, key=lambda r: (r[0] or "", r[1])))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([x.words, x.stems, x.exceptions, x.curve])])], ["lexicon"])

    found = rows.repartition(1).mapInArrow(run, "lexicon string").collect()
    return Lexicon(*json.loads(found[0][0])) if found else Lexicon()


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = documents(spark, sf_dir), labels(spark, sf_dir)
    lexicon = fit(docs, marks.where(crc_bucket(F.col("doc_id"), 3) != 1))
    return score_documents(docs, lexicon).select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
