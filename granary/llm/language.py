"""Language identification by nearest centroids.

A text is lower-cased and everything but letters becomes one space; its features are character
n-grams of one to three, hashed into `DIM` buckets, weighted by log counts and inverse document
frequency and normalised. Each language has up to `CLUSTERS` centroids from spherical k-means; the
language of the nearest centroid by cosine is predicted, and a text further than `REJECT` of all
centroids is flagged as rejected.

Document frequencies are counted over all texts that may be learnt from. The clustering reads a
sample of at most `SAMPLE` of them for each language: those with the lowest hashes of id and text.

Null texts, and texts without a letter, get `und` and score 0. Null langs and ids are never learnt
from, null langs are still predicted. With nothing to learn from all are `und`. Repeated rows are
predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, learnable, stored

DIM = 4096
CLUSTERS = 4
SAMPLE = 800
REJECT = 0.1
MOD, REST = 4, 2
UNKNOWN = "und"


def _numerals() -> str:
    """Ranges of what Python's word characters hold beside letters and decimal digits: fractions, superscripts, Roman
    and other numerals."""
    found = [c for c in range(0x110000) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    cuts = [0, *(k for k in range(1, len(found)) if found[k] != found[k - 1] + 1), len(found)]
    return "".join(f"{chr(found[a])}-{chr(found[b - 1])}" for a, b in zip(cuts, cuts[1:], strict=False))


#: Everything but letters.
_OTHER = re.compile(rf"[\W\d_{_numerals()}]+")
#: Characters that are hashed at once: long texts go in pieces that share two characters.
PIECE = 1 << 20


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts; None without any letter."""
    kept = _OTHER.sub(" ", (text or "").lower()).strip()
    if not kept:
        return None
    codes = np.frombuffer(f" {kept} ".encode("utf-32-le", "surrogatepass"), "<u4")
    total = np.zeros(DIM, np.int64)
    for k in range(0, max(1, len(codes) - 2), PIECE):
        c = codes[k : k + PIECE + 2].astype(np.uint32)
        own = c[:PIECE] if k + PIECE + 2 < len(codes) else c
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
        for n, grams in ((1, own), (2, two[: len(own)]), (3, three)):
            mixed = (grams + np.uint32(n)) * np.uint32(0xC2B2AE35)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x27D4EB2F)
            total += np.bincount(mixed >> np.uint32(20), minlength=DIM)
    return total


@dataclass
class Centroids:
    langs: list[str]
    idf: np.ndarray
    centres: np.ndarray  # (centroids, DIM), of unit length
    owner: np.ndarray

    def vectors(self, found: list[np.ndarray]) -> np.ndarray:
        x = np.log1p(np.stack(found)).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(lang, cosine, rejected?) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.langs:
            return out
        for k in range(0, len(texts), 256):
            found = [(i, c) for i, t in enumerate(texts[k : k + 256], k) if (c := counts(t)) is not None]
            if found:
                cosine = self.vectors([c for _, c in found]) @ self.centres.T
                for (i, _), best, score in zip(found, cosine.argmax(axis=1), cosine.max(axis=1), strict=True):
                    value = float(min(1.0, max(0.0, score)))
                    out[i] = (self.langs[self.owner[best]], value, value < REJECT)
        return out


def k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from spread-out rows; the same rows give the same centroids."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        # The row least like the chosen ones, leaving out the strangest hundredth.
        order = np.argsort(near, kind="stable")
        chosen.append(int(order[min(len(x) // 100, len(x) - 1)]))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        best = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[best == j].sum(axis=0) if (best == j).any() else centres[j] for j in range(len(centres))])
        moved = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centres, atol=1e-7):
            break
        centres = moved
    return centres


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIM + 1, np.int64), 0
    for b in batches:
        for t in b.column(0):
            if (c := counts(t.as_py())) is not None:
                seen[:DIM] += c > 0
                n += 1
    seen[DIM] = n
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(seen)], names=["k", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, rows, columns, values = [], [], [], []
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if (c := counts(text.as_py())) is not None:
                at = np.flatnonzero(c)
                langs.append(lang)
                columns.append(at.astype("<u2").tobytes())
                values.append(np.minimum(c[at], 0xFFFFFFFF).astype("<u4").tobytes())
        del rows
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(columns, pa.binary()), pa.array(values, pa.binary())], names=["lang", "k", "n"])


def fit(docs: DataFrame) -> Centroids:
    known = docs.where(learnable("doc_id", MOD, REST) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    seen = {r["k"]: r["n"] for r in known.select("text").mapInArrow(_frequencies, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # DIM + 1 rows
    total = seen.get(DIM, 0)
    idf = np.array([np.log((1 + total) / (1 + seen.get(k, 0))) + 1 for k in range(DIM)], np.float32)
    # A rate first, so that few rows are ranked; then the bound itself.
    size = known.groupBy("lang").count().select("lang", (F.lit(2.0 * SAMPLE + 50) / F.col("count")).alias("rate"))
    hashed = F.xxhash64("doc_id", "text")
    share = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    likely = known.join(F.broadcast(size), "lang").where(share < F.col("rate")).select("lang", "text", hashed.alias("h"))
    best = Window.partitionBy("lang").orderBy("h")
    chosen = likely.withColumn("k", F.row_number().over(best)).where(F.col("k") <= SAMPLE).select("lang", "text")
    rows = stored(chosen.mapInArrow(_sampled, "lang string, k binary, n binary"), "language-sample").orderBy("lang", "k", "n").collect()
    model = Centroids([], idf, np.zeros((0, DIM), np.float32), np.zeros(0, np.int64))
    by_lang: dict[str, list[np.ndarray]] = {}
    for r in rows:
        c = np.zeros(DIM, np.int64)
        c[np.frombuffer(r["k"], "<u2")] = np.frombuffer(r["n"], "<u4")
        by_lang.setdefault(r["lang"], []).append(c)
    centres, owner = [], []
    for i, (lang, found) in enumerate(sorted(by_lang.items())):
        own = k_means(model.vectors(found), CLUSTERS)
        model.langs.append(lang)
        centres.append(own)
        owner += [i] * len(own)
    if centres:
        model.centres, model.owner = np.concatenate(centres).astype(np.float32), np.array(owner)
    return model


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, lang_pred, score, rejected)."""
    rows = docs.select("doc_id", held_out("doc_id", MOD, REST).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                lang, score, rejected = zip(*model.predict(part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")


def op1_language(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "lang", "text")
    return identify(docs, fit(docs))
