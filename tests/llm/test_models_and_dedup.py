"""Near-duplicates, repeats, packing, language, toxicity and the language model against plain Python."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from granary.llm import bwt, language, lm, packing, simhash, suffix_dedup, toxicity
from granary.llm.common import components

from .helpers import EDGES, by_id, documents, saved

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = SPACE.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """pairs: (id, fingerprint); links at 4 or fewer differing bits; null ids never name a class."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    names = defaultdict(list)
    for i, (doc_id, _) in enumerate(pairs):
        names[find(i)].append(doc_id)
    return [min((x for x in names[find(i)] if x is not None), default=None) for i in range(len(pairs))]


def test_simhash(spark, tmp_path, small):
    rows = [*EDGES, (41, "The quick brown fox jumps over the lazy dog " * 40), (40, "the QUICK brown fox jumps over the lazy dog " * 40 + "once")]
    docs = documents(spark, tmp_path, rows)
    got = simhash.op7_simhash(docs).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    want = Counter((i, f"{fp:016x}", c) for (i, fp), c in zip(fps, plain_components(fps), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c if c is not None else "none" for c in plain_components(fps)})
    table = spark.read.parquet(f"{small}/documents.parquet")
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in table.select("doc_id", "text").collect()]
    want = Counter((i, f"{fp:016x}", c) for (i, fp), c in zip(fps, plain_components(fps), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op7_simhash(table).collect()) == want


def test_bit_planes_and_large_buckets(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(5)]
    fps = np.unique(np.concatenate([base, *flips, r.integers(0, 2**63, 3000, dtype=np.uint64)]))
    q, at = simhash.Planes(fps).near(fps[:50], 4)
    want = {(i, j) for i in range(50) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert set(zip(q.tolist(), at.tolist(), strict=True)) == want
    a, b = simhash.bucket_edges(fps)
    label = {int(x): int(x) for x in fps}
    find = lambda x: x if label[x] == x else find(label[x])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[find(x)] = find(y)
    for i in range(len(base)):
        assert len({find(int(f[i])) for f in (base, *flips)}) == 1
    # Chunked buckets lose no link.
    monkeypatch.setattr(simhash, "CHUNK", 3)
    monkeypatch.setattr(simhash, "SMALL", 2)
    sample = [int(x) for x in np.concatenate([base[:10], *(f[:10] for f in flips)])]
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in set(sample)], "fp long")
    root = {row.node: row.root for row in components(simhash.links(nodes)).collect()}
    pairs = [(x, x & (1 << 64) - 1) for (x,) in map(tuple, nodes.collect())]
    want = dict(zip([p[0] for p in pairs], plain_components([(p[0], p[1]) for p in pairs]), strict=True))
    assert {k: root.get(k, k) for k in want} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def plain_repeats(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def repeat_texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(150), prose(120)
    rows = [(k, prose(r.randint(5, 250))) for k in range(20)]
    rows += [(30 + k, prose(30) + passage[k * 7 :] + prose(20)) for k in range(8)]
    rows += [(50, other + prose(3) + other), (51, other[:405]), (52, other[1:401]), (53, other[:399]), (54, "ab" * 700), (55, "z" * 1200), (56, "z" * 399)]
    rows += [(60, rows[3][1]), (60, rows[3][1]), (61, "x" + rows[4][1]), (62, None), (63, "")]
    return rows


def test_repeats(spark, tmp_path):
    rows = repeat_texts()
    docs = documents(spark, tmp_path, rows)
    want = Counter((i, *x) for (i, _), x in zip(rows, plain_repeats([t for _, t in rows], 400), strict=True))
    got = suffix_dedup.op6_suffix_dedup(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(r.text is not None and len(r.text.encode()) <= r.n_bytes - r.n_removed for r in got)
    left = suffix_dedup.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert all(r.n_chars == len(r.text or "") for r in left.collect())
    # The column-wise transform finds the same starts.
    data = [(t or "").encode()[:700] for _, t in rows[:12] + rows[20:24] + [(0, rows[21][1][300:])]]
    found = bwt.repeated_starts(data, 100)
    seen = Counter(d[i : i + 100] for d in data for i in range(len(d) - 99))
    assert [x.tolist() for x in found] == [[i for i in range(len(d) - 99) if seen[d[i : i + 100]] > 1] for d in data]


@pytest.mark.parametrize("collection", [50_000, 3])
def test_repeats_by_the_transform(spark, tmp_path, monkeypatch, collection):
    """Edges of passages are decided by the transform, and by window hashes where a mark has too many strings."""
    calls = spark.sparkContext.accumulator(0)
    built = bwt.repeated_starts

    def counted(docs, span):
        calls.add(len(docs))
        return built(docs, span)

    monkeypatch.setattr(suffix_dedup, "repeated_starts", counted)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    rows = repeat_texts()
    r = random.Random(12)
    passage = rows[20][1]
    # One passage of just under a span with other neighbours each time, and cuts of a long one.
    rows += [(100 + k, "".join(r.choice("ab ") for _ in range(40)) + passage[200:592] + "".join(r.choice("ab ") for _ in range(40))) for k in range(40)]
    rows += [(200 + k, "".join(r.choice("cd ") for _ in range(9)) + passage[100 + k : 560 + 3 * k]) for k in range(12)]
    docs = documents(spark, tmp_path, rows)
    want = Counter((i, *x) for (i, _), x in zip(rows, plain_repeats([t for _, t in rows], 400), strict=True))
    assert Counter(tuple(x)[:5] for x in suffix_dedup.op6_suffix_dedup(docs).collect()) == want
    assert calls.value > 0


def test_transform_orders_suffixes():
    r = random.Random(1)
    for _ in range(60):
        docs = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 6))]
        suffixes = sorted((([x + 1 for x in d[i:]] + [0], k, i) for k, d in enumerate(docs) for i in range(len(d) + 1)), key=lambda s: s[:2])
        t = bwt.build(docs)
        assert list(zip(t.doc.tolist(), t.start.tolist(), strict=True)) == [(k, i) for _, k, i in suffixes]
        assert t.bwt.tolist() == [docs[k][i - 1] + 1 if i else 0 for _, k, i in suffixes]

        def shared(a, b):
            n = 0
            while a[n] == b[n] != 0:
                n += 1
            return n

        assert t.lcp.tolist() == [shared(suffixes[i - 1][0], s[0]) if i else 0 for i, s in enumerate(suffixes)]


def test_packing(spark, tmp_path, small):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*((i, t if t is None or len(t) < 10**5 else t[: 10**5]) for i, t in EDGES), (72, "a<|endoftext|>b <|startoftext|>"), (70, "it's we'll ﬁ ça é don't 12,3 <|endoftext|>  x y"), (71, "tok en " * 4095)]
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows += [(1000 + r.doc_id, r.text) for r in table.collect()]
    docs = documents(spark, tmp_path, rows)
    pieces = packing.op2_packing(docs).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    assert got.keys() == want.keys()
    for i, texts in want.items():
        assert sum(p.length for p in got[i]) == sum(map(len, texts))
        for p in got[i]:
            assert any(p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes()) for x in texts), i
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0
    assert packing.op2_packing(documents(spark, tmp_path, [], "none")).count() == 0


def test_fill_is_the_closest_sum():
    r = random.Random(2)
    for _ in range(100):
        counts = Counter(r.randint(1, 30) for _ in range(r.randint(1, 12)))
        best, used = packing.fill(sorted(counts, reverse=True), counts, 60)
        sums = {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums if s + k <= 60}
        assert best == max(sums) == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


def test_language(spark, tmp_path, medium):
    table = spark.read.parquet(f"{medium}/documents.parquet")
    rows = language.op1_language(table).join(table.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").collect()
    long = [r for r in rows if len(r.text) > 100]
    assert sum(r.lang == r.lang_pred for r in long) >= 0.97 * len(long)
    assert all(0 <= r.score <= 1 for r in rows)
    edge = documents(spark, tmp_path, [*EDGES, (90, "123 !!"), (93, "½ ² Ⅷ ৪ _"), (91, "the cat and the dog " * 9, "en"), (92, "le chat et le chien " * 9, "fr")])
    got = by_id(language.op1_language(edge))
    assert sum(map(len, got.values())) == len(EDGES) + 4
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in (1, 2, 3, 8, 90, 93))
    assert got[7][0].lang_pred in ("en", "fr")
    nothing = documents(spark, tmp_path, [(1, "the cat")], "nolang")
    assert language.op1_language(nothing).first().lang_pred == "und"


def test_toxicity(spark, tmp_path, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op4_toxicity(docs, labels).join(labels, "doc_id").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == k and r.held_out] for k in (1, 0))
    pairs = [(a > b) + 0.5 * (a == b) for a in toxic for b in clean]
    assert sum(pairs) / len(pairs) >= 0.88  # some labels are noise: shouted or repeated plain words
    assert sum(x >= 0.7 for x in clean) <= 0.03 * len(clean)
    edge = documents(spark, tmp_path, EDGES, "edge")
    none = saved(spark.createDataFrame([(None, None, None), (1, 0, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = toxicity.op4_toxicity(edge, none).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.drop_toxic(edge, none).columns == edge.columns
    assert toxicity.op4_toxicity(documents(spark, tmp_path, [], "none"), none).count() == 0


def test_lexicon_folds_and_excepts():
    x = toxicity.Lexicon({(toxicity.fold("idiot"), False): 4.0, (toxicity.fold("clown"), True): 2.0}, (toxicity.fold("clown fish"),))
    assert x.total("You 1d10ts and Іdiоt") == 8.0
    assert x.total("a clown fish, a clown") == 2.0
    assert x.total("sidiot clowns") == 0.0 and x.total(None) == 0.0
    r = random.Random(4)
    long = " ".join(r.choice(("clown", "clown fish", "fish", "plain")) for _ in range(60_000))
    alone = sum(1 for a, b in zip(long.split(), [*long.split()[1:], ""], strict=True) if a == "clown" and b != "fish")
    assert x.total(long) == 2.0 * alone


def plain_model(rows):
    """(doc_id, text) -> rows of the contract's base score."""
    tokens = [[*SPACE.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())), b"\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for x, h, (i, _) in zip(tokens, held, rows, strict=True) if not h and i is not None for w in x)
    n, v = sum(counts.values()), len(counts)
    return [(h, len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)) for x, h in zip(tokens, held, strict=True)], counts


def test_language_model(spark, tmp_path, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [*EDGES, *((1000 + r.doc_id, r.text) for r in table.collect())]
    got = defaultdict(list)
    for r in lm.op10_lm(documents(spark, tmp_path, rows)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    better = []
    for (i, _), (held, n_tokens, n_known, train, base) in zip(rows, plain_model(rows)[0], strict=True):
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, train), i
            assert r.base_score == pytest.approx(base, rel=1e-9)
            if held and n_tokens > 50:
                better.append(r.score > r.base_score)
    assert sum(better) > 0.7 * len(better)
    assert lm.op10_lm(documents(spark, tmp_path, [], "none")).count() == 0


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1), (5, 6), (1000, 5000), (1000, 10**12)):
        values = np.sort(r.integers(0, top, n))
        assert lm.EliasFano(values, top).decode().tolist() == values.tolist()
        assert lm.sorted_values(lm.sorted_bytes(values.astype(np.uint64))).tolist() == values.tolist()
        assert lm.plane_values(lm.plane_bytes(values % 2**32)).tolist() == (values % 2**32).tolist()
    counts = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert lm.count_values(lm.count_bytes(counts)).tolist() == counts.tolist()


def test_trie_search(tmp_path):
    """Every context's successors, and only these, are found, in levels that are mapped from the work file."""
    r = random.Random(1)
    pairs = sorted({(r.randrange(50), r.randrange(30)) for _ in range(400)} - {(7, w) for w in range(30)})
    parent, word = np.array(pairs).T
    trie = lm.Trie([(50, parent, word, np.ones(len(pairs), np.uint8), np.ones(50, np.uint8))], str(tmp_path))
    where = {p: k for k, p in enumerate(pairs)}
    asks = [(a, b) for a in range(50) for b in range(31)]
    assert trie.levels[0].find(*np.array(asks).T).tolist() == [where.get(x, -1) for x in asks]
    assert list(tmp_path.iterdir())
    trie.close()
    assert not list(tmp_path.iterdir())



def test_memory_of_a_bucket():
    """Bytes a token at the most while a bucket asks, and while it is scored: two of them and the JVM share an executor."""
    r = np.random.default_rng(2)
    n, kinds = 600_000, 80_000
    ids = np.minimum(r.zipf(1.2, n), kinds) - 1
    vocabulary = r.integers(0, 2**63, kinds, dtype=np.uint64)
    lengths = np.full(n // 200, 200)
    fields = (bytes([2, 1, 2] * (n // 600)), lengths.astype("<u4").tobytes(), vocabulary.tobytes(), lm.plane_bytes(ids))
    answers = lm.Bucket(*fields).asked()
    words = np.bincount(ids, minlength=kinds)

    def scored():
        own = lm.Bucket(*fields)
        trie = lm.Trie(lm.build(own, words, answers[1]))
        assert len(trie.probabilities(own, (words[own.ids] + 1) / 10**9)) == n
        trie.close()

    for step, most in ((lambda: lm.Bucket(*fields).asked(), 110), (scored, 110)):
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1] / n
        tracemalloc.stop()
        assert peak < most, peak


def plain_scores(rows):
    """log10 score of each text by the same smoothing, from plain counts of all n-grams of training texts."""
    tokens = [[*SPACE.findall((t or "").lower().encode()), b"\n"] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(tuple(x[i : i + n]) for x, h in zip(tokens, held, strict=True) if not h for n in (1, 2, 3) for i in range(len(x) - n + 1))
    words = [g for g in counts if len(g) == 1]
    base = sum(counts[g] for g in words) + len(words) + 1

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 1) / base
        prior = lm.PRIOR[len(gram) - 2]
        return (counts[gram] + prior * p(gram[1:])) / (counts[gram[:-1]] + prior)

    assert sum(p((*words[0][:1], *w)) for w in words) <= 1 + 1e-9  # what's left is for words never seen
    return [sum(math.log10(p(tuple(x[max(0, i - 2) : i + 1]))) for i in range(len(x))) for x in tokens]


def test_rare_ngrams_of_a_large_corpus(spark, tmp_path):
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2]
    r = random.Random(3)
    fill = " ".join(r.choice(("lorem", "ipsum", "dolor", "sit", "amet")) for _ in range(400_000))
    rows = [(train[0], fill), (train[1], "quartz vex jumps lorem"), (train[2], "a quartz vex jumps"), (held[0], "quartz vex jumps"), (held[1], "jumps vex quartz lorem ipsum"), (train[3], None)]
    got = {x.doc_id: x for x in lm.op10_lm(documents(spark, tmp_path, rows)).collect()}
    for (i, _), want in zip(rows, plain_scores(rows), strict=True):
        assert got[i].score == pytest.approx(want, abs=0.03 * got[i].n_tokens), i
    assert got[held[0]].score > got[held[0]].base_score + 5


def test_tasks_of_the_transform_follow_its_strings(spark, tmp_path, monkeypatch):
    """Small strings, long rounds: the transform's tasks go by the number of strings, and only rows of repeated marks are dealt by their wholes."""
    r = random.Random(3)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = [prose(700) for _ in range(20)]
    texts = [prose(2000) + shared[k % 20] + prose(2000) for k in range(60)]
    made = {}

    def kept(df, tag):
        out = stored(df, tag)
        made[tag] = (out.count(), len(out.inputFiles()))
        return out

    stored = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", kept)
    monkeypatch.setattr(suffix_dedup, "TASK", 5)
    got = {x.doc_id: x.n_removed for x in suffix_dedup.op6_suffix_dedup(documents(spark, tmp_path, list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(60)] == [x[1] for x in plain_repeats(texts, 400)]
    assert made["suffix-short"][0] > 50 and made["suffix-transformed"][1] > 4
    assert made["suffix-judged-again"][0] < made["suffix-groups"][0] / 2


def test_short_passages_are_reported(spark, tmp_path):
    """Passages of 51 words that repeat have columns of their own, however few bytes they have; the contract's columns and text go by 400 bytes."""
    r = random.Random(17)
    prose = lambda n: [f"{r.randint(0, 9999)}" for _ in range(n)]
    passage, short, whole = prose(51), prose(50), prose(200)
    texts = [[*prose(40), *p, *prose(30)] for p in (passage, passage, short, short)]
    texts += [[*prose(9), *passage, *prose(5), *passage], whole, whole, prose(120)]
    rows = [(k, ("\n" if k == 1 else " ").join(t)) for k, t in enumerate(texts)] + [(20, None), (21, "")]
    assert len(" ".join(passage)) < 400
    got = {x.doc_id: x for x in suffix_dedup.op6_suffix_dedup(documents(spark, tmp_path, rows)).collect()}
    assert [tuple(got[i])[:5] for i, _ in rows] == [(i, *x) for (i, _), x in zip(rows, plain_repeats([t for _, t in rows], 400), strict=True)]
    assert {i: x.n_passages for i, x in got.items() if x.n_passages} == {0: 1, 1: 1, 4: 2, 5: 1, 6: 1}
    for i, t in rows:
        left = (t or "").replace(" ".join(passage), "").replace("\n".join(passage), "").replace(" ".join(whole), "")
        assert got[i].text_left == left and got[i].text == ("" if i in (5, 6) else t or "")
