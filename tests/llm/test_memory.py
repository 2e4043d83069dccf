"""What a Python worker is handed at a time, and what it keeps."""
import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from tidewatch.llm import language, packing, queries
from tidewatch.sources.tables import small_batches

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_packing_hands_few_texts_at_a_time(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([len(b)], pa.int64())], ["n"])

    monkeypatch.setattr(packing, "token_pieces", lambda docs, *_: docs.mapInArrow(sizes, "n long"))
    monkeypatch.setattr(packing, "packed", lambda pieces, *_: pieces)
    before = spark.conf.get(BATCH)
    got = [r["n"] for r in packing.pack_documents(spark.range(0, 3000, 1, 1), "unused").collect()]
    assert sum(got) == 3000 and max(got) <= packing.ROWS_AT_ONCE
    assert spark.conf.get(BATCH) == before


def test_a_lower_limit_of_the_session_stays(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, 7)
    try:
        with small_batches(spark, 100):
            assert spark.conf.get(BATCH) == "7"
        with small_batches(spark, 5):
            assert spark.conf.get(BATCH) == "5"
        assert spark.conf.get(BATCH) == "7"
    finally:
        spark.conf.set(BATCH, before)


def test_a_worker_encodes_without_threads_of_its_own():
    code = ("import os, sys; from tidewatch.llm.packing import _Runs, encoded; runs = _Runs(sys.argv[1]); before = len(os.listdir('/proc/self/task'));"
            "[*encoded([' '.join(f'w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}' for i in range(9000))] * 3, runs)];"
            "print(len(os.listdir('/proc/self/task')) - before)")
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    got = subprocess.run([sys.executable, "-c", code, queries.tokenizer_path()], env=env | {"PYTHONPATH": os.pathsep.join(sys.path)},
                         capture_output=True, text=True, timeout=120)
    assert got.stdout.strip() == "0", got


def _network(labels, hidden=2):
    rng = np.random.default_rng(3)
    make = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    return language.Network(make(3, 2, 256, hidden), make(3, 2, hidden, hidden), make(2, hidden, labels), make(labels), [str(i) for i in range(labels)])


def test_windows_at_once_are_those_of_the_whole():
    rng = np.random.default_rng(1)
    data = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 64, 65, 640, 0, 5000, 128, 63, 0)]
    want = language.windows_of(data, 64)
    for most in (1, 7, 1024):
        got = [np.concatenate(v) for v in zip(*language._windows_at_once(iter(data), 64, most))]
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
    net, settings = _network(3), language.Settings(at_once=7)
    best, score = language.label_texts(net, iter(data), settings)
    x, used, owner = want
    p = language.position_probabilities(net, language._run(net, x)[0]) * (np.arange(64)[:, None] < used)
    mean = np.stack([np.bincount(owner, s, len(data)) for s in p.sum(axis=1)]) / np.maximum([len(d) for d in data], 1)
    assert (best == mean.argmax(axis=0)).all() and np.allclose(score, mean.max(axis=0), atol=1e-5)
    assert [len(v) for v in language.label_texts(net, [], settings)] == [0, 0]


def test_labelling_holds_the_windows_of_one_step():
    data = [bytes([97 + i % 26]) * 40_000 for i in range(200)]
    tracemalloc.start()
    try:
        language.label_texts(_network(2), data, language.Settings(at_once=256))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4_000_000, peak  # of 8 MB of texts
