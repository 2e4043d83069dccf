"""Packing, mixing, language, page text and nearest neighbours against plain Python, and held-out accuracy."""
import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import language, mixing, multi_index, packing, page_text
from tidewatch.llm.queries import mixed

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
SF = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def test_ids_are_those_of_whole_texts(tokenizer):
    odd = ["a'b it's <|endoftext|> x", "ªº µ 12½3 Ünïcode ǅ é ß İi", "a\x1cb c", "¡¿×÷", "", "  ", None, "don't--stop!!12ab", "A\x0b9.9\x0c—", "Привет мир",
           "日本語 x", "é ñ", "x" * 5000, " a b", "<|startoftext|>", "ÀÉÎ õü ÿ Ÿ ŒŒ"]
    runs = packing._Runs(WORDS)
    for _ in range(2):
        for text, ids in zip(odd, packing.encoded(odd, runs)):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_fill_sequences(spark, odd_docs, tokenizer, capacity):
    pieces = packing.token_pieces(odd_docs, WORDS, capacity, with_ids=True)
    got = packing.packed(pieces.cache(), capacity).collect()
    texts = defaultdict(dict)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.start == r.piece * capacity
        texts[r.row_id][r.piece] = ids.tolist()
    whole = sorted([i for k in sorted(p) for i in p[k]] for p in texts.values())
    assert whole == sorted(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in odd_docs.collect())
    assert all(len(p[k]) == capacity for p in texts.values() for k in sorted(p)[:-1])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(r.length for r in got) // capacity) + 1


def test_nothing_to_pack(no_docs):
    assert packing.pack_documents(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_fullest_combination(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(41, np.int64)
    for length in rng.integers(1, 25, 6):
        counts[length] += rng.integers(1, 4)
    for space in range(1, 41):
        sums = {0}
        for length in np.flatnonzero(counts[:space + 1]):
            sums = {s + k * int(length) for s in sums for k in range(int(counts[length]) + 1) if s + k * length <= space}
        chosen = packing._fullest(space, counts)
        assert sum(k * n for k, n in chosen.items()) == max(sums) and all(n <= counts[k] for k, n in chosen.items())


def test_few_sequences():
    rng = np.random.default_rng(0)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 2049, 20_000), return_counts=True))}
    runs = packing.minimum_bin_slack(counts, 2048)
    need = max(-(-sum(k * n for k, n in counts.items()) // 2048), sum(n for k, n in counts.items() if k > 1024))  # no two long ones fit
    assert {k: sum(r.count * r.times for r in runs if r.length == k) for k in counts} == counts
    assert max(r.first + r.times for r in runs) <= need + max(2, need // 500)


def test_raking_meets_targets():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 50, (5, 4, 3)).astype(float)
    targets = [np.full(5, 0.2), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.3, 0.2])]
    raked = mixing.rake(table, targets)
    for axis, want in enumerate(targets):
        assert np.allclose(raked.sum(axis=tuple(a for a in range(3) if a != axis)), want, atol=1e-8)
    assert (raked[table == 0] == 0).all()


def test_mixture(spark, odd_docs, no_docs):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "if(id % 5 = 0, null, 'en') AS lang",
                                          "10 + id % 11 AS tokens")
    targets = {"source": {"hot": 0.1, "s0": 0.2, "other": 0.7}, "lang": {"en": 0.6}}
    got = mixing.mixture(docs, targets).toPandas()
    assert got["probability"].max() == 1 and got["probability"].min() > 0
    kept = got[got["kept"]]
    share = kept.groupby("source")["tokens"].sum() / kept["tokens"].sum()
    assert abs(share["hot"] - 0.1) < 0.02 and abs(share["s0"] - 0.2) < 0.02
    assert abs(kept[kept["lang"].isna()]["tokens"].sum() / kept["tokens"].sum() - 0.4) < 0.02
    odd = mixed(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("kept IS NULL OR weight IS NULL").count() == 0 and odd.columns.count("kept") == 1
    assert mixed(no_docs).count() == 0


def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(0)
    h, n = 3, 2
    net = language.Network(rng.standard_normal((3, 2, 256, h)), rng.standard_normal((3, 2, h, h)), rng.standard_normal((2, h, n)), np.zeros(n), ["a", "b"])
    x, y, mask = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((4, 6), np.float32)
    mask[0, 4:] = 0
    for w in ("table", "recur", "out", "bias"):
        setattr(net, w, getattr(net, w).astype(np.float32))
    _, grads = language._gradients(net, x, y, mask)
    for weight, grad in zip((net.table, net.recur, net.out, net.bias), grads):
        for at in [np.unravel_index(int(k), grad.shape) for k in np.argsort(-np.abs(grad).ravel())[:3]]:
            step = 0.02
            weight[at] += step
            up, _ = language._gradients(net, x, y, mask)
            weight[at] -= 2 * step
            down, _ = language._gradients(net, x, y, mask)
            weight[at] += step
            assert abs((up - down) / (2 * step) - grad[at]) < 0.02 * max(1e-2, abs(grad[at]))


def test_languages(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.where(language.held_out(F.col("doc_id"))), net).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in found)
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)
    odd = language.identify(odd_docs, net).collect()
    said = [(r.text, r.lang_pred, r.score) for r in odd]
    assert len(odd) == odd_docs.count() and {p for t, p, _ in said if t is None or not any(c.isalpha() for c in t)} == {"und"}
    assert all(p in net.labels for t, p, _ in said if t and any(c.isalpha() for c in t))
    assert language.fit(no_docs) is None and language.fit(odd_docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {(r.lang_pred, r.score) for r in language.identify(odd_docs, None).collect()} == {("und", 0.0)}
    assert language.identify(no_docs, net).count() == 0


def test_a_text_is_read_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.fit(docs)
    data = [r.text.encode() for r in docs.where("lang = 'de'").limit(20).collect()]
    for one in data:
        x, used, _ = language.windows_of([one], 64)
        p = language.position_probabilities(net, language._run(net, x)[0])
        total = sum(p[:, k, w] for w in range(len(x)) for k in range(used[w]))
        best, score = language.label_texts(net, [one], language.Settings())
        assert used.sum() == len(one) and np.argmax(total) == best[0] and abs(total.max() / len(one) - score[0]) < 1e-4


ODD_PAGES = [(1, None), (2, ""), (3, "plain text only"), (4, "<p>open<br>and <b>bold</b>&nbsp;&amp;  more<p>next"), (5, "<div" * 50), (6, "<!-- never closed <p>x"),
             (7, "<script>if (a < b) '<p>no</p>'</script><article><p>yes &lt;b&gt;</p></article>"), (8, "<a href='x>y\">z"), (8, "<article>" + "<p>word</p>" * 3000)]


def test_blocks():
    text = lambda page: [b.text for b in page_text.blocks_of(page)]
    assert text(ODD_PAGES[3][1]) == ["open and bold & more", "next"]
    assert text(ODD_PAGES[6][1]) == ["yes <b>"]
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><style>p{}</style>e<title>f</title>") == ["a", "b", "c", "d", "e"]
    assert page_text.blocks_of("<article><p>x<p>y<nav>z</nav></article>")[1].path == ["root", "article", "p"]
    assert len(text(ODD_PAGES[8][1])) == 3000 and text(None) == []


def test_page_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    net = page_text.fit(pages)
    for r in page_text.extract(pages, net).collect():
        assert r.text == "\n".join(b.text for b in page_text.blocks_of(r.html) if "article" in b.path) and r.n_chars == len(r.text)
    unseen = """<html><body><div id="top-header"><a href=x>Home</a> <a>About</a></div><div class="sidebar"><p>Popular posts here</p></div>
    <div class="content"><h1>A title</h1><p>This is the first paragraph of a long story, with several words &amp; commas.</p>
    <p>Second paragraph goes on; it has more to say about things.</p></div><div class="comments"><p>Nice post!</p><p>I agree, thanks.</p></div>
    <div class="cookie-notice">We use cookies.</div><form><label>Name</label></form><footer>(c) 2020</footer></body></html>"""
    rows = spark.createDataFrame([(i, h, "mine") for i, h in [*ODD_PAGES, (9, unseen)]], "page_id long, html string, text string")
    got = page_text.extract(rows, net).collect()
    assert len(got) == len(ODD_PAGES) + 1
    by_page = {r.page_id: r.text for r in got}
    assert by_page[1] == by_page[2] == "" and by_page[7] == "yes <b>"
    assert by_page[9] == ("A title\nThis is the first paragraph of a long story, with several words & commas.\n"
                          "Second paragraph goes on; it has more to say about things.")
    assert page_text.fit(rows.limit(0)) is None and page_text.extract(rows.limit(0), None).count() == 0
    assert {r.text for r in page_text.extract(rows, None).collect()} == {""}


def test_visits_cells_in_order():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(7), rng.random(9), rng.integers(0, 4, (7, 9))
    order = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(9) if counts[i, j])
    for need in (0, 1, 20, 10**6):
        got = multi_index.visited_cells(a, b, counts, need)
        assert got == [(i, j) for _, i, j in order][:len(got)] and (len(got) == len(order) or counts[tuple(zip(*got))].sum() >= need if got else need == 0)


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 8))
    x[300:600] = x[0]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(901, None), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [1.0] * 3), (None, [1.0] * 8),
                                                           (905, [None] + [1.0] * 7), (906, [float("inf")] + [1.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.array(x, np.float32).astype(float)
    asked = frame.where("vec_id % 100 = 0")
    for settings, least in ((multi_index.Settings(share=1.0, entries=100, queries=3), 1.0), (multi_index.Settings(centroids=16, share=0.5, least=50), 0.8)):
        got = defaultdict(list)
        for r in multi_index.nearest(frame, asked, 10, settings=settings).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        recall = []
        for q in range(0, 900, 100):
            far = np.sqrt(((x - x[q]) ** 2).sum(1))
            want = [int(i) for i in np.lexsort((np.arange(900), far)) if i != q][:10]
            assert len(got[q]) == 10 and all(abs(far[i] - s) < 1e-12 for i, s in got[q]) and sorted(got[q], key=lambda p: (p[1], p[0])) == got[q]
            recall.append(len({i for i, _ in got[q]} & set(want)) / 10)
        assert np.mean(recall) >= least
    few = multi_index.nearest(frame.where("vec_id < 4"), asked).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 0] == [i for i in np.argsort(((x[:4] - x[0]) ** 2).sum(1)) if i]
    assert multi_index.nearest(frame.limit(0), asked).count() == 0 and multi_index.nearest(frame.where("vec_id > 900"), asked).count() == 0


def test_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    pdf = frame.toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    found = defaultdict(set)
    for r in multi_index.nearest(frame, frame.where("vec_id % 100 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for k in np.flatnonzero(ids % 100 == 0):
        far = ((x - x[k]) ** 2).sum(1)
        far[k] = np.inf
        hits.append(len(found[ids[k]] & set(ids[np.argsort(far)[:10]])) / 10)
    assert np.mean(hits) >= 0.9
