"""What a question asks for: Column expressions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def any_of(text: Column, signals: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(s) for s in signals))


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Any pattern, found anywhere; classes and boundaries as in Unicode text."""
    return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def is_compound(q: Column, words: tuple[str, ...] = L.WH_WORDS) -> Column:
    low, wh = F.lower(q), "|".join(words)
    patterns = (rf"\band\b.*\b({wh})", rf"\b({wh})\b.*\band\b", rf"\bor\b.*\b({wh})", rf"[,;].*\b({wh})")
    return matches(low, patterns) | (F.regexp_count(low, F.lit(rf"(?U)\b({wh})\b")) >= 2)


def intent(q: Column) -> Column:
    """struct<type, is_recordkeeping, is_procedural, is_summarization, is_document_query, is_compound, tenths>."""
    low = F.lower(q)
    rec, proc, summ, doc, comp = any_of(low, L.RECORDKEEPING), any_of(low, L.PROCEDURAL), any_of(low, L.SUMMARIZATION), matches(low, L.DOCUMENT_PATTERNS), is_compound(q)
    kind = F.when(summ | (doc & ~proc & ~rec), "summarization").when(rec, "recordkeeping").when(proc, "procedural").otherwise("general")
    return F.struct(kind.alias("type"), rec.alias("is_recordkeeping"), proc.alias("is_procedural"), summ.alias("is_summarization"), doc.alias("is_document_query"), comp.alias("is_compound"))


#: Strong signals of each intent, two tenths of confidence each.
STRONG = {
    "recordkeeping": ("what records", "which records", "maintain", "recordkeeping"),
    "procedural": ("how to", "procedure for", "steps to"),
    "summarization": ("summarize", "summary", "overview", "explain the"),
}


def confidence_tenths(q: Column, found: Column, strong: dict[str, tuple[str, ...]] = STRONG) -> Column:
    """Confidence in tenths, 10 at most: kept whole so that thresholds are exact."""
    low = F.lower(q)
    count = F.lit(0)
    for kind, signals in strong.items():
        count = count + F.when(found["type"] == kind, sum((low.contains(s).cast("int") for s in signals), F.lit(0))).otherwise(0)
    tenths = 2 * count + F.when((found["type"] == "summarization") & found["is_document_query"], 2).otherwise(0) + F.when(found["is_compound"], 1).otherwise(0)
    return F.least(F.lit(10), tenths)


def confidence_level(tenths: Column) -> Column:
    return F.when(tenths >= 6, "high").when(tenths >= 3, "medium").otherwise("low")


def entities(q: Column, kind: str) -> Column:
    """Names of one kind that the question shows, in declared order."""
    low = F.lower(q)
    return F.array_compact(F.array(*(F.when(matches(low, tuple(rf"\b{p}\b" for p in patterns)), name) for name, patterns in L.ENTITIES[kind])))


def forms(q: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(q), F.lit("(?U)" + L.FORMS), 1)))


def entity_summary(found: dict[str, Column]) -> Column:
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(f"{k}: "), F.array_join(c, ", "))) for k, c in found.items()]
    text = F.concat_ws(" | ", *parts)
    return F.when(text == "", "No specific entities detected").otherwise(text)


def enhance_with_entities(q: Column, regulations: Column, equipment: Column, procedures: Column) -> Column:
    named = F.concat(regulations, F.slice(equipment, 1, 2), F.slice(procedures, 1, 2))
    new = F.filter(named, lambda x: ~F.lower(q).contains(F.lower(x)))
    return F.concat_ws(" ", q, F.when(F.size(new) > 0, F.array_join(new, " ")))


def enhance_for_forms(q: Column) -> Column:
    """The question with record words, if it names an NP 133 form; null otherwise."""
    out = F.replace(F.lower(q), F.lit("enter in"), F.lit("maintain in"))
    for word in L.FORM_KEYWORDS:
        out = F.when(out.contains(word.lower()), out).otherwise(F.concat(out, F.lit(f" {word}")))
    return F.when(F.exists(forms(q), lambda f: f.contains("NP") & f.contains("133")), out)


def needs_rewriting(q: Column) -> Column:
    words = F.regexp_count(q, F.lit(r"(?U)\S+"))
    generic = reduce(or_, (F.trim(F.lower(q)).startswith(w) for w in L.GENERIC_STARTERS))
    return (words < 6) | (generic & (words < 10))


def accepted_rewrite(original: Column, rewrite: Column) -> Column:
    """The rewrite without quotes around it, or the original if that is over three times longer or under three words."""
    clean = F.trim(F.regexp_replace(rewrite, "^[\"']+|[\"']+$", ""))
    bad = (F.char_length(clean) > 3 * F.char_length(original)) | (F.regexp_count(clean, F.lit(r"\S+")) < 3)
    return F.when(bad | clean.isNull(), original).otherwise(clean)


def conversation_id(client: Column, given: Column, request: Column) -> Column:
    """`client:given` without blanks around it, unless it starts so already in any case; a blank id is a fresh one, made from the
    request's own id, so that no two conversations share it and a retry finds it again."""
    own = F.trim(given)
    fresh = F.concat(client, F.lit(":"), F.left(F.sha1(request.cast("string").cast("binary")), F.lit(12)))
    return F.when(F.coalesce(own, F.lit("")) == "", fresh).when(F.startswith(F.lower(own), F.lower(F.concat(client, F.lit(":")))), own).otherwise(F.concat(client, F.lit(":"), own))


def enhanced(q: Column, with_entities: bool = True, rewrite=None) -> Column:
    """The question that is searched for: with form words if it names a form, else with its entities (if asked for), else as it is.
    rewrite: a function of Columns that goes first, the question itself by default."""
    asked = q if rewrite is None else accepted_rewrite(q, rewrite(q))
    named = enhance_with_entities(asked, entities(q, "regulations"), entities(q, "equipment"), entities(q, "procedures"))
    return F.coalesce(enhance_for_forms(asked), named if with_entities else F.lit(None).cast("string"), asked)


def normal_name(name: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(name)), F.lit("")), F.lit(fallback))
