"""Rule mining: informative terms of each text, pruned by document frequency; synonyms; enrichment."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .common import texts_by_id

TOKEN = r"[A-Za-z][A-Za-z0-9\\-_/]+"
_FIND = re.compile(TOKEN).findall
#: Texts whose terms are held at once, and words whose counts are.
SLICE, HELD = 500, 200_000


def _terms(text: str | None, stop: frozenset[str]) -> list[str]:
    found = _FIND(text or "")
    return [t for t in " ".join(found).lower().split(" ") if t not in stop] if found else []


def _best(texts: list[str | None], stop: frozenset[str], most: int) -> list[tuple[str, float, bool]]:
    """The `most` best (term, score, is_phrase). Counters keep the order of first places, and sorts keep it for ties."""
    each = [_terms(t, stop) for t in texts]
    if len(each) == 1:
        w = each[0]
        rows = [(t, float(n), False) for t, n in Counter(w).items()] + [(" ".join(t), 1.5 * n, True) for t, n in Counter(pairwise(w)).items()]
        return heapq.nlargest(most, rows, key=lambda x: x[1])
    found: dict[tuple[bool, str], tuple[float, int]] = {}
    for w in each:
        for is_phrase, one, terms in ((False, 1.0, w), (True, 1.5, map(" ".join, pairwise(w)))):
            for pos, t in enumerate(terms):
                score, first = found.get((is_phrase, t), (0.0, pos))
                found[is_phrase, t] = (score + one, min(first, pos))
    order = sorted(found.items(), key=lambda x: (-x[1][0], x[0][0], x[1][1], x[0][1]))
    return [(t, score, is_phrase) for (is_phrase, t), (score, _) in order[:most]]


def best_terms(docs: DataFrame, k: int = 25, stop: tuple[str, ...] = L.STOP, generic: tuple[str, ...] = L.GENERIC) -> DataFrame:
    """(doc_id, text) -> (doc_id, best), best an array of structs (term, score, rank, is_phrase): a word counts 1, a pair of neighbours 1.5 times;
    neither holds stop or generic words. Of each text the max(2k, k + 10) best, ties by where words come before pairs and by first place; terms
    under three characters go afterwards. Terms are counted where a text lies: only ids that come twice are shuffled."""
    without, most = frozenset(stop + generic), max(2 * k, k + 10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                ends, rows = [0], []
                for texts in part.column(1):
                    rows += [(t, score, rank, is_phrase) for rank, (t, score, is_phrase) in enumerate(_best(texts.as_py(), without, most), 1) if len(t) >= 3]
                    ends.append(len(rows))
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                fields = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.bool_()), strict=True)]
                best = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["term", "score", "rank", "is_phrase"]))
                yield pa.RecordBatch.from_arrays([part.column(0), best], names=["doc_id", "best"])

    rows = texts_by_id(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, best array<struct<term string, score double, rank bigint, is_phrase boolean>>")


def top_terms(docs: DataFrame, k: int = 25) -> DataFrame:
    """(doc_id, text) -> (doc_id, term, score, rank, is_phrase): `best_terms` as rows."""
    return best_terms(docs, k).select("doc_id", F.inline("best"))


def document_frequency(docs: DataFrame, stop: tuple[str, ...] = L.STOP, generic: tuple[str, ...] = L.GENERIC) -> DataFrame:
    """(term, df): in how many texts each word is, stop and generic words left out. Tasks send counts, not words."""
    without = frozenset(stop + generic)

    def counts(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                found.update(set(_terms(text.as_py(), without)))
                if len(found) >= HELD:
                    yield counts(found)
                    found = Counter()
        yield counts(found)

    return docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def pruned_lists(best: DataFrame, df: DataFrame, max_df: int = 25, max_unigrams: int = 8, min_phrase_ratio: float = 0.6) -> DataFrame:
    """`best_terms` -> (doc_id, patterns): phrases, and single words of four characters or more that few texts have: max_unigrams at most,
    and no more than leave phrases their share. Texts meet the rare words in one row a word; their phrases travel in one row more."""
    slim = best.select("doc_id", F.transform("best", lambda x: F.struct(x["rank"].alias("rank"), x["term"].alias("term"), x["is_phrase"].alias("is_phrase"))).alias("best"))
    phrases = F.transform(F.filter("best", lambda x: x["is_phrase"]), lambda x: x["term"])
    words = F.transform(F.filter("best", lambda x: ~x["is_phrase"] & (F.char_length(x["term"]) >= 4)), lambda x: F.struct(x["term"].alias("key"), x["rank"].alias("rank"), F.lit(None).cast("array<string>").alias("phrases")))
    # No word begins with a blank: the row of the phrases meets none, and rows of many texts don't share a key.
    own = F.struct(F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), F.lit(None).cast("long").alias("rank"), phrases.alias("phrases"))
    each = slim.select("doc_id", F.explode(F.concat(F.array(own), words)).alias("x")).select("doc_id", "x.*")
    met = each.join(df.where(F.col("df") <= max_df).select(F.col("term").alias("key"), F.lit(True).alias("rare")), "key", "left").where("rank is null or rare")
    kept = met.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", F.col("key").alias("term"))))).alias("words"), F.first("phrases", ignorenulls=True).alias("phrases"))
    kept = kept.select("doc_id", "phrases", F.slice("words", 1, max_unigrams).alias("words"))
    p, u = F.size("phrases"), F.size("words")
    low = (p > 0) & (p < min_phrase_ratio * (p + u))
    most = F.when(low, F.greatest(F.lit(0).cast("long"), F.floor(p / min_phrase_ratio - p))).otherwise(u).cast("int")
    return kept.select("doc_id", F.concat("phrases", F.transform(F.slice("words", F.lit(1), most), lambda x: x["term"])).alias("patterns")).where(F.size("patterns") > 0)


def pruned(best: DataFrame, df: DataFrame, max_df: int = 25, max_unigrams: int = 8, min_phrase_ratio: float = 0.6) -> DataFrame:
    """`pruned_lists` as rows (doc_id, term, place)."""
    return pruned_lists(best, df, max_df, max_unigrams, min_phrase_ratio).select("doc_id", F.posexplode("patterns").alias("k", "term")).select("doc_id", "term", (F.col("k") + 1).cast("long").alias("place"))


def is_noisy(s: Column) -> Column:
    t = F.trim(F.coalesce(s, F.lit("")))
    return (F.char_length(t) < 2) | t.rlike("(?i)" + "|".join(f"(?:{p})" for p in L.NOISY))


def synonym_groups(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, term) joined with (term_id, synonym): base -> sorted variants without noise and the base itself."""
    base, variant = F.lower(F.trim("term")), F.lower(F.trim("synonym"))
    both = terms.join(synonyms, terms["id"] == synonyms["term_id"]).where(~is_noisy(F.col("synonym")) & (base != variant))
    return both.groupBy(base.alias("base")).agg(F.array_sort(F.collect_set(variant)).alias("variants"))


def spellings(acronym: Column) -> Column:
    """The word, and for capitals and digits of three or more also dotted and spaced."""
    parts = F.split(acronym, "")
    letters = F.filter(parts, lambda c: c != "")
    more = F.array(acronym, F.array_join(letters, "."), F.array_join(letters, " "))
    return F.when(acronym.rlike("^[A-Z0-9]{3,}$"), more).otherwise(F.array(acronym))


def phrase_pattern(phrase: str) -> str:
    """A literal phrase as a pattern: any run of spaces, hyphens and slashes between its words."""
    return r"[\s\-/]+".join(re.escape(w) for w in phrase.split())


def acronym_pattern(term: str) -> str | None:
    """A term as a pattern that finds it in any case: a phrase between what isn't a letter or digit, with any blanks and hyphens between its words; a
    single word as it is or with dots and blanks between its letters, wherever it stands."""
    t = term.strip()
    letters = re.sub("[^A-Za-z0-9]", "", t)
    if not letters:
        return None
    if " " in t or "-" in t:
        return rf"(?i)(?<![A-Z0-9]){re.escape(t).replace(chr(92) + ' ', '[' + chr(92) + 's' + chr(92) + '-]+')}(?![A-Z0-9])"
    spaced = r"\.?\s*".join(letters)
    return f"(?i)(?:{re.escape(t)}|{spaced})"


def enrich(chunks: DataFrame, rules: list[tuple[str, int, list[str]]], synonyms: dict[str, list[str]], form: str = "word") -> DataFrame:
    """Tags of each text: viq:<rule>, chap:<chapter>, syn:<base>, sorted. A rule is one alternation, compiled
    once; it fires once however many of its patterns match. form: how synonyms are found: "word", base or variant between
    word boundaries; "acronym", base or variant by `acronym_pattern`; "variant", variants alone, anywhere."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))

    def names(base: str, variants: list[str]) -> str:
        if form == "acronym":
            return "|".join(p for v in (base, *variants) if (p := acronym_pattern(v)))
        if form == "variant":
            return "|".join(phrase_pattern(v.lower()) for v in variants)
        return "(?U)" + "|".join(rf"\b{phrase_pattern(v.lower())}\b" for v in (base, *variants))

    hits = [(name, chapter, low.rlike("|".join(phrase_pattern(p.lower()) for p in patterns))) for name, chapter, patterns in rules if patterns]
    found = [F.when(hit, F.array(*([F.lit(f"viq:{name}")] + ([] if chapter is None else [F.lit(f"chap:{chapter}")])))) for name, chapter, hit in hits]
    called = [(base, low.rlike(p)) for base, variants in synonyms.items() if (p := names(base, variants))]
    found += [F.when(hit, F.array(F.lit(f"syn:{base}"))) for base, hit in called]
    none = F.array().cast("array<string>")
    listed = lambda values: F.array_join(F.array_compact(F.array(*values)) if values else none, ",")
    tags = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*found)))) if found else none)
    return chunks.withColumns({
        "domain_tags": tags,
        "viq_hints": listed([F.when(hit, name) for name, _, hit in hits]),
        "viq_chapters": listed([F.when(hit, str(chapter)) for _, chapter, hit in hits if chapter is not None]),
        "synonym_hits": listed([F.when(hit, base) for base, hit in sorted(called, key=lambda x: x[0])]),
    })


def enrich_by_code(chunks: DataFrame, rules: list[dict], groups: list[dict | str]) -> DataFrame:
    """The same for rules {code, patterns, tags} and groups {name, terms} or single terms: patterns are used as they are written, terms
    between word boundaries; rules without a code are left out."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    coded = [(r["code"], r.get("tags", []), text.rlike("(?i)" + "|".join(f"(?:{p})" for p in r["patterns"]))) for r in rules if "code" in r and r.get("patterns")]
    named = [({"name": g, "terms": [g]} if isinstance(g, str) else {"name": g.get("name", (g.get("terms") or ["unknown"])[0]), "terms": g.get("terms", [])}) for g in groups]
    called = [(g["name"], text.rlike("(?iU)" + "|".join(rf"\b{re.escape(t)}\b" for t in g["terms"]))) for g in named if g["terms"]]
    none = F.array().cast("array<string>")
    listed = lambda values: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*values)))) if values else none, ",")
    tags = [F.when(hit, F.array(F.lit(f"viq:{code}"), *map(F.lit, own))) for code, own, hit in coded] + [F.when(hit, F.array(F.lit(f"syn:{name}"))) for name, hit in called]
    every = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*tags))))) if tags else none, ",")
    return chunks.withColumns({"viq_hints": listed([F.when(hit, code) for code, _, hit in coded]), "domain_tags": every, "synonym_hits": listed([F.when(hit, name) for name, hit in called])})


def usable(rows: DataFrame) -> DataFrame:
    """Questions with an id and some text of question or requirements, trimmed."""
    t = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("viq_no", "viq_question", "procedural_requirements")}
    out = rows.select("chapter_no", *(v.alias(k) for k, v in t.items()))
    return out.where((F.col("viq_no") != "") & ((F.col("viq_question") != "") | (F.col("procedural_requirements") != "")))


def build_rules(rows: DataFrame, top: int = 25, max_df: int = 25, max_unigrams: int = 8, min_phrase_ratio: float = 0.6) -> DataFrame:
    """Questions (viq_no, chapter_no, viq_question, procedural_requirements) -> rules (viq_no, chapter_no, patterns): the best terms of each,
    pruned by how many questions have them; a question without any has no rule."""
    texts = usable(rows).select(F.col("viq_no").alias("doc_id"), "chapter_no", F.concat_ws("\n", "viq_question", "procedural_requirements").alias("text"))
    found = pruned_lists(best_terms(texts.select("doc_id", "text"), top), document_frequency(texts), max_df, max_unigrams, min_phrase_ratio)
    return found.join(texts.select("doc_id", F.col("chapter_no").cast("int").alias("chapter_no")), "doc_id").select(F.col("doc_id").alias("viq_no"), "chapter_no", "patterns")


def synonym_map(pairs: DataFrame) -> DataFrame:
    """(base, synonym or null) -> (base, variants): bases of three letters or more get their dotted and spaced spellings too; noisy variants
    go, and bases without any."""
    clean = pairs.select(F.lower(F.trim("base")).alias("base"), F.lower(F.trim("synonym")).alias("synonym")).where("base <> ''")
    letters = F.filter(F.split(F.regexp_replace("base", "[^a-z0-9]", ""), ""), lambda c: c != "")
    more = F.when(F.size(letters) >= 3, F.array(F.array_join(letters, "."), F.array_join(letters, " "))).otherwise(F.array().cast("array<string>"))
    every = clean.select("base", F.col("synonym").alias("s")).unionByName(clean.select("base", F.explode(more).alias("s")))
    return every.where("s is not null and s <> ''").where(~is_noisy(F.col("s"))).groupBy("base").agg(F.array_sort(F.collect_set("s")).alias("variants"))
