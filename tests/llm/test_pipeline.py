"""The pipeline's rows against its stages in plain Python, on a small table."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import similar, simhash

from .helpers import EDGES, documents, saved
from .test_models_and_dedup import plain_components, plain_fingerprint, plain_repeats, repeat_texts
from .test_text_rules import plain_hits


def remaining(texts, span=400):
    """Each text without the bytes of strings of `span` that start elsewhere too; split characters go."""
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        out.append(bytes(c for c, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_pipeline(spark, tmp_path):
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(300 + i, t if t is None or len(t) < 10**5 else t[:3000]) for i, t in EDGES if i is not None and i != 5] + repeat_texts()[:-4]
    rows += [(200, "you idiot, pathetic scum, worthless moron " * 3), (201, "a kind word about a trash can"), (202, f"before {leak} after words"), (203, "near copy of one text " * 30), (204, "near copy of one text " * 30)]
    documents(spark, tmp_path, rows)
    saved(spark.createDataFrame([(1, leak)], "item_id long, text string"), tmp_path, "benchmark")
    saved(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    clean = [(i, t) for i, t in rows if i != 200]
    found = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == sorted(i for i, _ in clean)
    roots = plain_components([(i, plain_fingerprint(t)) for i, t in clean])
    first = {}
    for (i, t), root in zip(clean, roots, strict=True):
        if root not in first or i < first[root][0]:
            first[root] = (i, t)
    single = list(first.values())
    assert 204 not in [i for i, _ in single] and 203 in [i for i, _ in single]
    cut = list(zip([i for i, _ in single], remaining([t for _, t in single]), strict=True))
    assert any(r[1] for r in plain_repeats([t for _, t in single], 400))
    left = {i: t for i, t in cut if not plain_hits(t, [(1, leak)])[1]}
    assert 202 not in left

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id].append(p)
    assert got.keys() == left.keys()
    for i, t in left.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(got[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    assert docs.where(F.col("doc_id") == 200).count() == 1


def test_near_copies_of_the_stage(spark, tmp_path):
    """Brute force over five-word shingles; most of these pairs differ in more than four fingerprint bits."""
    r = random.Random(4)
    prose = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    rows, far = [(1, None), (2, " \n"), (3, "one two"), (4, "ONE  two")], 0
    for k in range(12):
        base = prose(r.randint(60, 400))
        for j in range(4):
            text = list(base)
            for _ in range(j * len(base) // 150):
                text[r.randrange(len(text))] = "other"
            rows.append((10 + 4 * k + j, " ".join(text)))
    rows += [(100 + k, " ".join(prose(200) + ["the", "same", "license", "line", "here", "always"])) for k in range(30)]
    chain = prose(300)
    rows += [(200 + k, " ".join(chain[8 * k : 250 + 8 * k])) for k in range(6)]
    sets = []
    for _, t in rows:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                far += (plain_fingerprint(rows[i][1]) ^ plain_fingerprint(rows[j][1])).bit_count() > 4
                label = [label[j] if x == label[i] else x for x in label]
    assert far > 5
    want = {min(i for (i, _), x in zip(rows, label, strict=True) if x == own) for own in label}
    docs = documents(spark, tmp_path, rows)
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(x.doc_id for x in got.collect()) == sorted(want)


def test_passages_of_more_than_fifty_words(spark, tmp_path):
    """Strings of 51 words go though they have under 400 bytes; those of 50 stay."""
    r = random.Random(9)
    prose = lambda n: [f"{r.randint(0, 9999)}" for _ in range(n)]
    long, short, gap = prose(51), prose(50), prose(70)
    texts = [[*prose(40), *p, *prose(30)] for p in (long, long, short, short, gap, gap[3:68])] + [long, gap[:51], prose(20) * 6]
    rows = [(k, ("\n" if k == 1 else " ").join(t)) for k, t in enumerate(texts)] + [(90, None), (91, " ")]
    rows += [(100 + i, t) for i, t in enumerate(x for _, x in repeat_texts())]
    assert len(" ".join(long)) < 400
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    want = []
    for (_, t), w, left in zip(rows, split, marked([t for _, t in rows]), strict=True):
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        for i in range(len(w) - 50):
            if seen[tuple(w[i : i + 51])] > 1:
                left[at[i][0] : at[i + 50][1]] = False
        want.append(bytes(c for c, x in zip((t or "").encode(), left, strict=True) if x).decode("utf-8", "ignore"))
    docs = documents(spark, tmp_path, rows)
    got = corpus_pipeline.repeated_passages(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert Counter((x.doc_id, x.text or "", x.n_chars) for x in got.collect()) == Counter((i, w, len(w)) for (i, _), w in zip(rows, want, strict=True))
    assert want[6] == "" and " ".join(short) in want[2]


def marked(texts, span=400):
    """For each text, which bytes are outside strings of `span` that start elsewhere too."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = [np.ones(len(d), bool) for d in data]
    for d, left in zip(data, out, strict=True):
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                left[i : i + span] = False
    return out


def test_candidates_stay_in_their_tasks(spark, tmp_path, monkeypatch):
    """Copies in a large group, few of them linked to the first: no step gives a row a pair, in whole buckets or in chunks."""
    r = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(160):
        text = list(base)
        for _ in range(r.choice((1, 2, 4))):
            text[r.randrange(len(text))] = f"x{k}"
        rows.append((k, " ".join(text)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    label, pairs = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                label = [label[j] if x == label[i] else x for x in label]
    want = sorted({label.index(x) for x in label})
    docs = documents(spark, tmp_path, rows)
    made = []

    def counted(df, tag):
        out = stored(df, tag)
        made.append((out.count(), tag))
        return out

    stored = similar.stored
    monkeypatch.setattr(similar, "stored", counted)
    asked, links = [], simhash.links
    monkeypatch.setattr(similar, "links", lambda x: asked.append(1) or links(x))
    for chunk in (1024, 50):
        monkeypatch.setattr(similar, "CHUNK", chunk)
        assert sorted(x.doc_id for x in similar.deduplicate(docs).collect()) == want
    assert 1 < len(want) < 120 and pairs > 1000
    assert asked, "the stage compares fingerprints"
    assert max(n for n, tag in made if tag != "similar-candidates") <= 15 * len(rows), sorted(made)


def test_agreement_of_linked_pairs():
    assert similar.least_agreeing(0.8) == 76 and similar.least_agreeing(1.0) == similar.BANDS * similar.ROWS
