"""Collocations, source divergence and fingerprints against plain Python."""
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS
from tidewatch.llm import collocation, divergence, fingerprint
from tidewatch.llm.queries import LOWER, UPPER
from tidewatch.llm.registry import load

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(UPPER, LOWER)


def phrases_by_hand(rows, least):
    total, count = Counter(), Counter()
    for r in rows:
        lang = r.lang if r.lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (r.text or "").translate(FOLD)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                count.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    often = {g: n for g, n in count.items() if n >= least}
    gone = {(g[0], *g[i:j]) for g, n in often.items() for i in range(1, len(g)) for j in range(i + 2, len(g) + 1)
            if j - i < len(g) - 1 and n >= often[(g[0], *g[i:j])]}
    found = defaultdict(list)
    for g, a in often.items():
        if len(g) > 2 and g not in gone:
            lang, words, n = g[0], g[1:], total[g[0]]
            score, _, left, right = min((1000 * a * n // (often[(lang, *words[:k])] * often[(lang, *words[k:])]), k,
                                         often[(lang, *words[:k])], often[(lang, *words[k:])]) for k in range(1, len(words)))
            found[lang].append((-score, -a, " ".join(words).encode(), left, right, n))
    return {lang: sorted(v) for lang, v in found.items()}


def phrases_found(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.lang, r["rank"])):
        found[r.lang].append((-r.score, -r.a, r.phrase.encode(), r.l, r.r, r.n))
        assert r["rank"] == len(found[r.lang])
    return dict(found)


@pytest.mark.parametrize("least", [2, 5])
def test_phrases(spark, odd_docs, least):
    passage = " ".join(f"w{i}" for i in range(70))
    rows = [(i, f"{passage} and a b a b a b a b a b a {i}", "xx", "s", 1) for i in range(6)] + [(9, "\x00 odd\xa0word   x. y" * 5, None, None, 1)]
    rows += [(20 + i, "of the of the of the, of the. The end\tof the\x0bof the", "xx", "s", 1) for i in range(40)]
    for docs in (spark.createDataFrame(rows, DOCS), odd_docs.drop("fp").limit(6).unionByName(odd_docs.drop("fp")),
                 spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")):
        want = phrases_by_hand(docs.collect(), least)
        assert phrases_found(collocation.collocations(docs, least, 10**6)) == want
        assert phrases_found(collocation.collocations(docs, least, 3)) == {k: v[:3] for k, v in want.items()}


def test_paths_are_compacted(spark, monkeypatch):
    """A passage is one path, cut into rows of bounded length, and branches where its copies differ."""
    passage = " ".join(f"w{i}" for i in range(40))
    grams = [(" ".join(passage.split()[i:i + 5]), 3) for i in range(36)] + [("w36 w37 w38 w39", 2), ("w37 w38 w39 other", 1), ("w36 w37 w38 w39 other", 1)]
    graph = spark.createDataFrame([("en", *g) for g in grams], "lang string, gram string, n long")
    paths = collocation.compact_paths(graph, collocation.word_graph(graph)).collect()
    assert sorted((r.n, r.words) for r in paths) == [(1, "w36 w37 w38 w39 other"), (3, passage)]
    monkeypatch.setattr(collocation, "PATH_EDGES", 10)
    paths = collocation.compact_paths(graph, collocation.word_graph(graph)).where("n = 3").orderBy("part").collect()
    assert [len(r.words.split()) for r in paths] == [14, 14, 14, 10]


def test_long_texts_are_cut_at_pieces():
    import pyarrow as pa

    text = "one two three. four five, six! " * 50 + "x" * 300 + " end"
    whole, first = collocation.split_words(pa.array([text]))
    words, marks = [], []
    for part in collocation._cut(pa.array([text]), 64):
        assert len(part) == 1
        w, f = collocation.split_words(part)
        words, marks = words + w.to_pylist(), marks + f.tolist()
    assert words == whole.to_pylist() and marks == first.tolist()


def test_no_words(spark, no_docs):
    assert collocation.collocations(no_docs).count() == 0
    assert collocation.collocations(spark.createDataFrame([(1, None, None, None, 1), (2, " ", "en", "s", 1)], DOCS), 1).count() == 0


def divergence_by_hand(rows, least, top):
    in_docs, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").translate(FOLD))
        in_docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = {t for t, n in in_docs[lang].items() if n >= least}
        whole = Counter()
        for s in sources:
            whole.update({t: n for t, n in counts[lang, s].items() if t in kept})

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("least,top,cells", [(1, 3, 20), (2, 50, 200_000), (10**6, 50, 200_000)])
def test_divergence(spark, odd_docs, monkeypatch, least, top, cells):
    monkeypatch.setattr(divergence, "SHARD_CELLS", cells)
    odd = odd_docs.limit(10**6)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    more = spark.createDataFrame([(i, t, lang, s, 1) for i, (t, lang, s) in enumerate(
        [("a a B", "x", "1"), ("a b c É", "x", "2"), ("", "x", "3"), ("a'b", None, "1"), (None, None, None), ("1 2 3", "y", "1"), ("a", "x", "1")])], DOCS)
    for frame in (odd, docs, more):
        got = [tuple(r) for r in divergence.source_divergence(frame, least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == divergence_by_hand(frame.collect(), least, top)


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {tuple(r) for r in divergence.term_counts(docs).collect()}
    batches = [b.cast(b.schema) for b in docs.select("text", "lang", "source").toArrow().to_batches(max_chunksize=37)]
    monkeypatch.setattr(divergence, "HELD_ROWS", 3000)
    parts = list(divergence._partial_counts(iter(batches)))
    assert len(parts) > 3
    total = Counter()
    for part in parts:
        for r in part.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    assert dict(total) == {w[:3]: w[3] for w in want}


def test_no_sources(no_docs):
    assert divergence.source_divergence(no_docs).count() == 0


def tree_by_hand(text):
    def digest(kind, value):
        return hashlib.sha256((kind + value).encode()).hexdigest()

    import base64
    sections, digests = [], []
    for block in re.findall(fingerprint.SECTION, text or ""):
        if not block:
            continue
        paragraphs, inner = [], []
        for line in block.split("\n"):
            leaves = [digest("l", x) for x in re.findall(fingerprint.LEAF, line)]
            inner.append(digest("p", "".join(leaves)))
            paragraphs.append("".join(base64.b64encode(bytes.fromhex(x[:6])).decode() for x in leaves))
        sections.append(".".join(paragraphs))
        digests.append(digest("s", "".join(inner)))
    return digest("r", "".join(digests)) + ":" + ";".join(sections).translate(str.maketrans("+/", "-_"))


def likeness_by_hand(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = (set(re.findall("[A-Za-z0-9_-]{4}", m[65:])) for m in (a, b))
    return 2.0 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def signed_hash(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def edits_by_hand(rows):
    docs = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda d: (d[0] is None, -(d[0] or 0), signed_hash(d[1]), d[1]))
    out = []
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        marks = [tree_by_hand(t) for t in (text, edited, after)]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], likeness_by_hand(*marks[:2]), likeness_by_hand(marks[0], marks[2])))
    return Counter(out)


@pytest.mark.parametrize("cell_rows", [2, 4096])
def test_edits(spark, odd_docs, monkeypatch, cell_rows):
    monkeypatch.setattr(fingerprint, "CELL_ROWS", cell_rows)
    ids = [2**62, -(2**62), 5, 5, 5, 5, None, None, None, None, -1, 0, 1, 2**40, 2**40 + 1, 2**40 + 5000]
    wide = spark.createDataFrame([(i, f"text {n % 3}\n\nof {i} words here, and more of them in a line 😀 é" if n % 4 else "same", None, None, 0) for n, i in enumerate(ids)], DOCS)
    for docs in (odd_docs, wide, wide.limit(1), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = docs.collect()
        got = fingerprint.edit_check(docs).collect()
        assert Counter(tuple(r)[:7] for r in got) == edits_by_hand(rows)
        assert all((r.changed == 0) == (r.fingerprint[:64] == r.edited_fingerprint[:64]) or r.changed == 0 for r in got)


def test_no_fingerprints(no_docs):
    assert fingerprint.edit_check(no_docs).count() == 0


def test_places_of_edits(spark):
    a = "\n".join(f"paragraph {i} of this text" for i in range(40))
    b = a.replace("paragraph 3 ", "paragraph three ").replace("paragraph 20 ", "")
    pair = spark.createDataFrame([(a, b), (a, a), ("", a), ("x", "")], "a string, b string").select(
        fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    found = [[tuple(p) for p in r[0]] for r in pair.select(fingerprint.changed_paragraphs(F.col("a"), F.col("b"))).collect()]
    assert found[0] == [(0, 3), (1, 4)] and found[1] == [] and found[3] == [(0, 0)]
    near = [r[0] for r in pair.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    assert 0.9 < near[0] < 1 and near[1] == 1 and near[2] == near[3] == 0


def test_fingerprints_run_no_python(spark):
    frame = fingerprint.edit_check(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_edited_texts_are_nearer_than_the_next(spark):
    got = load()[0]["op13_fingerprint"](spark, SF).where("n_chars > 100").collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)
