"""SimHash components and similar lines against all pairs in plain Python."""
import re
import string
from math import ceil

import numpy as np
import pytest
import xxhash

from tidewatch.llm import components, line_dedup, numbering, queries, simhash

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def simhash_by_hand(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    runs = [" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(nodes, linked):
    root = {n: n for n in nodes}

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {n: up(n) for n in nodes}


def by_hand(rows):
    fps = [simhash_by_hand(r.text) for r in rows]
    names = sorted(set(fps))
    links = [(a, b) for a in names for b in names if a < b and (a ^ b).bit_count() <= 3]
    roots = components_by_hand(names, links)
    least = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            least[roots[f]] = min(least.get(roots[f], r.doc_id), r.doc_id)
    return sorted((r.doc_id if r.doc_id is not None else -1, f, least.get(roots[f], -1)) for r, f in zip(rows, fps))


@pytest.mark.parametrize("node_rows", [1 << 20, 3])
def test_components(spark, odd_docs, node_rows):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = simhash.near_groups(docs, node_rows=node_rows).collect()
        known = lambda v: -1 if v is None else v
        assert sorted((known(r.doc_id), r.fp % 2**64, known(r.component_id)) for r in got) == by_hand(docs.collect())


def test_fingerprints_close_by(spark):
    """Random fingerprints with neighbours 1 to 4 bits away, all below few trie nodes: every link of 3 bits is found, none of 4."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**62, 30)]
    fps = set(base)
    for x in base:
        for k in (1, 2, 3, 4):
            fps.add(x ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    fps |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(0, 40, 3) for b in range(1, 40, 3)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    want = components_by_hand(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3])
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for node_rows in (1 << 20, 8):
        got = {r.node: r.root for r in components.connected_components(simhash.linked_fingerprints(frame, 3, node_rows)).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS u", "id + 1 AS v")
    assert {(r.node, r.root) for r in components.connected_components(edges).collect()} == {(i, 0) for i in range(201)}


def test_one_of_each_component_stays(odd_docs, no_docs):
    stays = simhash.near_dedup(odd_docs)
    fps = {simhash_by_hand(r.text) for r in odd_docs.collect()}
    roots = components_by_hand(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    assert stays.columns == odd_docs.columns and stays.count() == len(set(roots.values()))
    assert simhash.near_dedup(no_docs).count() == 0


def lines_by_hand(rows, least=5, t=0.8):
    first, found = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is not None, rows[i].doc_id or 0, i))
    for i in order:
        for k, line in enumerate((rows[i].text or "").split("\n")):
            words = frozenset(line.translate(FOLD).encode().split())
            if len(words) >= least:
                first.setdefault(words, (i, k))
                found.append((i, k, words))
    sets = list(first)
    place = {w: n for n, w in enumerate(sets)}
    linked = {w: [x for x in sets if x is not w and len(w & x) >= t * len(w | x) - 1e-9] for w in sets}
    return sorted((i, k, rows[first[w][0]].doc_id, first[w][1], len(linked[w]), first[w] != (i, k) or any(place[x] < place[w] for x in linked[w]))
                  for i, k, w in found)


@pytest.mark.parametrize("group", [20_000, 2])
def test_lines(spark, group):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").coalesce(1)
    rows = docs.collect()
    number = {r.doc_id: i for i, r in enumerate(rows)}
    got = line_dedup.similar_lines(docs, settings=line_dedup.Settings(group=group)).collect()
    assert sorted((number[r.doc_id], r.line, r.class_doc_id, r.class_line, r.links, r.removed) for r in got) == lines_by_hand(rows)


def test_many_variants_of_a_line(spark):
    """Each line swaps words of one passage: all pairs are links, and all but the first go."""
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(w if k != i % 30 else f"new{i}" for k, w in enumerate(words))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for group in (20_000, 7):
        got = line_dedup.similar_lines(docs, settings=line_dedup.Settings(group=group)).collect()
        assert sorted((r.doc_id, r.line, r.class_doc_id, r.class_line, r.links, r.removed) for r in got) == lines_by_hand(docs.collect())
        assert [r.doc_id for r in got if not r.removed] == [0] and {r.links for r in got} == {59}


def test_odd_lines(odd_docs, no_docs):
    got = line_dedup.line_dedup(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert (9, "Line one of five words here\nshort\n\nanother line with more words in it") in texts
    assert {(2, None), (3, ""), (4, "   \n\t "), (12, "a"), (None, None)} <= texts
    assert (0, "Alpha beta gamma delta epsilon zeta eta theta.") in texts and (1, "") in texts
    assert line_dedup.similar_lines(no_docs).count() == 0 and line_dedup.line_dedup(no_docs).count() == 0


def test_prefix_is_long_enough():
    for n in range(5, 80):
        assert n - ceil(0.8 * n - 1e-9) + 1 >= n - line_dedup._shared(np.array([n]), np.array([n]), 0.8)[0] + 1


@pytest.mark.parametrize("group", [20_000, 2])
def test_query_takes_lines_of_few_words(spark, tmp_path, group):
    """Sets of 1 to 4 words: equal ones are one class, and one of four words is linked to those of five that hold it."""
    texts = ["Home\nread more\nread more here\na b c d", "HOME\nmore read\n\n  \nBE!! SCUM!! BE!! SCUM!! BE!! SCUM!!", "a b c d e\nx a b c d\nb c d",
             "be!! scum!!\nhome home\nq a b c d e\nread more here now", None, "a b c\nonce only"]
    texts += [f"d c b a z{i}\na b c y{i}\nw{i}\na b c d z{i} zz{i}" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = lines_by_hand(docs.collect(), least=1)
    shown = lambda found: sorted((r.doc_id, r.line, r.class_doc_id, r.class_line, r.links, r.removed) for r in found.collect())
    assert shown(line_dedup.similar_lines(docs, settings=line_dedup.Settings(words=1, group=group))) == want
    assert shown(queries.op9(spark, str(tmp_path))) == want
    assert len(want) > 60 and {(1, 0), (1, 1), (3, 1), (2, 0), (6, 0)} <= {w[:2] for w in want if w[5]}


def test_rare_words_come_first_at_any_count(spark):
    """Counts past 255 still differ, so frequent words stay behind less frequent ones as tables grow."""
    words = {"once": 1, "few": 3, "some": 300, "often": 3000, "always": 40_000}
    docs = spark.createDataFrame([(" ".join([w] * n),) for w, n in words.items()], "text string").repartition(3)
    settings = line_dedup.Settings()
    counts = line_dedup.word_counts(docs, "text", settings)
    codes = [int(counts[int(line_dedup.words_of(w.encode())[0][0]) >> (64 - settings.counters)]) for w in words]
    assert codes[:2] == [1, 3] and codes == sorted(set(codes))
    assert (line_dedup._coded(line_dedup._VALUES) == np.arange(256)).all()


@pytest.mark.parametrize("group", [20_000, 2])
def test_pair_is_looked_at_under_its_first_word(spark, group):
    """Two lines that share all their rare words are a pair in one group, not in that of each word; a repeated line posts its words once."""
    common = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(common)), (1, " ".join([*common, "alone"])), (2, "\n".join([" ".join(reversed(common))] * 3))]
    docs = numbering.rows_once(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), False)
    settings = line_dedup.Settings(group=group)
    lines = line_dedup.line_rows(docs, line_dedup.word_counts(docs, "text", settings), "doc_id", "text", settings)
    assert lines.count() == 5 and lines.where("length(prefix) > 0").count() == 2
    posts = np.concatenate([line_dedup._unpacked(r.posts) for r in line_dedup.postings(lines, settings).collect()], axis=1)
    assert len({int(k) >> 32 for k in posts[0]}) == 8
    found = line_dedup._with_partner(posts, settings.similarity)
    assert len({int(k) >> 32 for k in found["key"]}) == 1 and found["id"].nunique() == 2


def test_postings_pack_and_unpack():
    posts = np.random.default_rng(3).integers(0, 2**64 - 1, (5, 11), np.uint64, endpoint=True)
    assert (line_dedup._unpacked(line_dedup._packed(posts[:, 2:9])) == posts[:, 2:9]).all()
