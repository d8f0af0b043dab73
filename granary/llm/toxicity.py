"""Toxicity by a weighted lexicon.

Texts are folded one character to one (lower case, homoglyphs to Latin letters, digit and sign
substitutions, and l with i), so folded positions are those of the text. One Aho-Corasick
automaton finds all terms: whole words, and stems that must start a word. A hit inside an
exception phrase doesn't count; of hits with one start the weightiest does. The sum of weights,
alone and per thousand characters, gives the score by a logistic curve.

Fitting reads at most `SAMPLE` labelled documents of each class (those whose ids have the lowest
hashes). Terms are the words and word starts whose document log-odds between the classes reach
`MIN_ODDS`, with support in several contexts, so that one copied passage can't bring its words in;
exception phrases are word pairs around a term that clean documents use more. Without labelled
rows a small built-in lexicon serves.

Null and empty texts score as texts without a hit. Null ids are never learnt from. Repeated rows
are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnable, stored

SAMPLE = 4000
MIN_ODDS, MIN_DOCS, MIN_CONTEXTS, MIN_SHARE = 4.0, 5, 5, 0.01
STEM = range(4, 9)
TERMS, PHRASES = 2000, 500
THRESHOLD = 0.7
MOD, REST = 3, 1

_GLYPHS = {
    "аàáâãäåαａ": "a", "вßβ": "b", "сϲçｃ": "c", "ԁ": "d", "еёєεèéêëｅ": "e", "ɡ": "g", "һнｈ": "h", "іїιìíîïｉｌlӏ1!|": "i", "јј": "j", "кκ": "k", "мｍ": "m",
    "пηñｎ": "n", "оοσøòóôõöｏ0": "o", "рρｐ": "p", "ԛ": "q", "гｒ": "r", "ѕｓ5$": "s", "тτｔ7": "t", "υμùúûüｕ": "u", "ѵνｖ": "v", "ԝωｗ": "w", "хχｘ": "x", "уγýÿｙ": "y", "ｚ": "z", "3": "e", "4@": "a",
}
#: Accents and Latin letters with marks stay apart: they tell words of real languages from one another.
_KEEP = set("àáâãäåßçèéêëìíîïñøòóôõöùúûüýÿ")
FOLD = {ord(c): latin for glyphs, latin in _GLYPHS.items() for c in glyphs if c not in _KEEP}

DEFAULT_TERMS = {("idiot", True): 4.0, ("moron", True): 4.0, ("scum", True): 4.0, ("worthless", True): 3.0, ("pathetic", True): 3.0, ("stupid", True): 3.0}
DEFAULT_PHRASES = ("clown fish", "trash can", "trash bin", "class clown")


def lower(text: str) -> str:
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def fold(text: str) -> str:
    return lower(text).translate(FOLD)


_WORD = re.compile(r"[^\W_]+")


def _inside(at: int, spans: list[tuple[int, int]], longest: int) -> bool:
    """Whether any span holds `at`. Spans come in order of their ends and are `longest` characters at most, so few of
    them are looked at, however long the text."""
    k = bisect.bisect_left(spans, at, key=lambda s: s[1])
    while k < len(spans) and spans[k][1] < at + longest:
        if spans[k][0] <= at:
            return True
        k += 1
    return False


@dataclass
class Lexicon:
    """terms: (folded term, whole word?) -> weight; phrases: folded exceptions; curve: bias, weight
    of log(1 + sum), weight of log(1 + sum per thousand characters)."""

    terms: dict[tuple[str, bool], float]
    phrases: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-3.0, 2.5, 0.5)
    automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "phrases": self.phrases, "curve": self.curve, "automaton": None}

    def _built(self):
        if self.automaton is None:
            values: dict[str, list] = {}
            for (term, whole), weight in self.terms.items():
                values.setdefault(term, []).append((whole, weight))
            for phrase in self.phrases:
                values.setdefault(phrase, []).append((True, None))
            self.automaton = ahocorasick.Automaton()
            for term, found in values.items():
                self.automaton.add_word(term, (len(term), found))
            self.automaton.make_automaton()
        return self.automaton

    def total(self, text: str | None) -> float:
        """Sum of the weights of all hits."""
        if not text or not (self.terms or self.phrases):
            return 0.0
        plain, best, spans = None, {}, []
        for end, (size, found) in self._built().iter(fold(text)):
            plain = plain or lower(text)
            start = end - size + 1
            if start and plain[start - 1].isalnum():
                continue
            closed = end + 1 == len(plain) or not plain[end + 1].isalnum()
            for whole, weight in found:
                if whole and not closed:
                    continue
                if weight is None:
                    spans.append((start, end))
                else:
                    best[start] = max(best.get(start, 0.0), weight)
        if spans:
            longest = max(map(len, self.phrases))
            best = {at: w for at, w in best.items() if not _inside(at, spans, longest)}
        return sum(best.values())

    def curve_of(self, total: float, length: int) -> float:
        b, s, d = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + s * math.log1p(total) + d * math.log1p(1000 * total / max(length, 100))))))

    def score(self, text: str | None) -> float:
        return self.curve_of(self.total(text), len(text or ""))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> a row for each distinct folded word of a document, with a word before it."""
    for b in batches:
        rows: dict[str, list] = {"word": [], "toxic": [], "before": []}
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen, before = {}, ""
            for word in map(str, _WORD.findall(lower(text or ""))):
                word = word.translate(FOLD)
                if len(word) >= STEM[0]:
                    seen.setdefault(word, before)
                before = word
            rows["word"] += seen
            rows["before"] += seen.values()
            rows["toxic"] += [toxic] * len(seen)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("word", pa.string()), ("toxic", pa.int32()), ("before", pa.string())]))


def choose_terms(counts: dict[tuple[str, bool], tuple[int, int, int]], n_toxic: int, n_clean: int) -> dict[tuple[str, bool], float]:
    """(term, whole?) -> (toxic docs, clean docs, contexts) to weighted terms: of a chain of starts
    with nearly the same support the longest, and a whole word where it has nearly all of a start's."""
    odds = lambda t, c: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    good = {k: (t, odds(t, c)) for k, (t, c, x) in counts.items() if t >= max(MIN_DOCS, MIN_SHARE * n_toxic) and x >= MIN_CONTEXTS and odds(t, c) >= MIN_ODDS}
    longest: dict[str, int] = {}
    for (term, whole), (t, _) in good.items():
        for k in STEM:
            if k < len(term) or (whole and k == len(term)):
                longest[term[:k]] = max(longest.get(term[:k], 0), t)
    chosen = {k: v for k, v in good.items() if k[1] or longest.get(k[0], 0) < 0.8 * v[0]}
    stems = {term for term, whole in chosen if not whole}
    inside = lambda term: any(term[:k] in stems for k in STEM if k < len(term))
    return {k: round(v[1], 4) for k, v in sorted(chosen.items(), key=lambda x: (-x[1][0], x[0]))[:TERMS] if not inside(k[0])}


def fit_curve(totals: np.ndarray, lengths: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; classes weigh alike."""
    x = np.stack([np.ones(len(totals)), np.log1p(totals), np.log1p(1000 * totals / np.maximum(lengths, 100))], axis=1)
    w = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(totals)
    b, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (toxic - p)) - ridge @ b)
    return tuple(float(v) for v in np.round(b, 6))


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    known = labels.where(learnable("doc_id", MOD, REST)).where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.where("toxic = 1").orderBy(*order).limit(SAMPLE).unionByName(known.where("toxic = 0").orderBy(*order).limit(SAMPLE)).distinct()
    # At most 2 * SAMPLE ids of 12 bytes.
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxicity-sample")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({(fold(t), w): x for (t, w), x in DEFAULT_TERMS.items()}, tuple(map(fold, DEFAULT_PHRASES)))
    seen = sample.mapInArrow(_contexts, "word string, toxic int, before string")
    by_word = seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("before"))).alias("x"))
    starts = F.transform(F.filter(F.array(*map(F.lit, STEM)), lambda k: k <= F.char_length("word")), lambda k: F.struct(F.left(F.col("word"), k).alias("term"), F.lit(False).alias("whole")))
    terms = by_word.select("t", "c", "x", F.inline(F.array_append(starts, F.struct(F.col("word").alias("term"), F.lit(True).alias("whole")))))
    least = F.col("t") >= max(MIN_DOCS, MIN_SHARE * n_toxic)
    counts = terms.groupBy("term", "whole").agg(*(F.sum(k).alias(k) for k in "tcx")).where(least & (F.col("x") >= MIN_CONTEXTS) & (F.log(F.col("t") / n_toxic) - F.log((F.col("c") + 0.5) / n_clean) >= MIN_ODDS - 1))
    best = counts.orderBy(F.desc("t"), "term", "whole").limit(10 * TERMS).collect()
    lexicon = Lexicon(choose_terms({(r["term"], r["whole"]): (r["t"], r["c"], r["x"]) for r in best}, n_toxic, n_clean), tuple(map(fold, DEFAULT_PHRASES)))
    lexicon.phrases += _phrases(seen, lexicon)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.total(t) for t in texts], pa.float64()), pa.array([len(t or "") for t in texts], pa.int64()), b.column(0)], names=["s", "n", "toxic"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(totals, "s double, n long, toxic int").collect()], float)
    lexicon.curve = fit_curve(rows[:, 0], rows[:, 1], rows[:, 2])
    return lexicon


def _phrases(seen: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Pairs (word before, term) that clean documents of the sample use more than toxic ones."""
    whole = [t for t, w in lexicon.terms if w][:TERMS]
    if not whole:
        return ()
    pairs = seen.where(F.col("word").isin(whole) & (F.col("before") != "")).groupBy("before", "word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    rows = pairs.where("c >= 3 and c > 2 * t").orderBy(F.desc("c"), "before", "word").limit(PHRASES).collect()
    return tuple(f"{r['before']} {r['word']}" for r in rows)


def scored(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, score) for each row."""
    rows = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array([lexicon.score(t.as_py()) for t in b.column(len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], score], names=[*keep, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[: len(keep)])
    return rows.mapInArrow(run, f"{schema}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold."""
    lexicon, at = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([lexicon.score(t.as_py()) < THRESHOLD for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs.select("doc_id", "text", held_out("doc_id", MOD, REST).alias("held_out")), fit(docs, labels), ("doc_id", "held_out"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
