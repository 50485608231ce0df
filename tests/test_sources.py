import hashlib
import os
import signal
import subprocess
import sys
import time

import pytest

from sparvec.operators.textsearch import DocumentSearch
from sparvec.sources import recordlog
from sparvec.sources.glovetext import read_embedding_text
from sparvec.sources.randomvectors import random_vectors


# Fixed values of the scenarios: the two lines of the tiny text file, ten "record_" records, three good ones before 30
# bytes of garbage, five before a kill.
def test_text_scan(spark, tmp_path):
    p = tmp_path / "tiny.txt"
    p.write_text("cat 0.5 0.5\n\n  dog \t 0.5  1.0 \n   \nowl 1e-3 -2\nbad x y\n")
    rows = read_embedding_text(spark, str(p), 2, 3).orderBy("id").collect()
    assert [(r["id"], r["term"]) for r in rows] == [(0, "cat"), (1, "dog"), (2, "owl")] and rows[1]["vector"] == [0.5, 1.0]
    with pytest.raises(ValueError, match="line 6"):
        read_embedding_text(spark, str(p), 2, 9)
    with pytest.raises(ValueError, match="line 1"):
        read_embedding_text(spark, str(p), 3, 3)
    p.write_text("cat 0.5 nan\n")
    with pytest.raises(ValueError):
        read_embedding_text(spark, str(p), 2, 1)
    p.write_text("\n\n")
    assert read_embedding_text(spark, str(p), 2, 5).count() == 0
    with pytest.raises(Exception):
        read_embedding_text(spark, str(tmp_path / "none"), 2, 5)
    for d, n in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            read_embedding_text(spark, str(p), d, n)


def test_random_vectors_do_not_depend_on_partitions(spark):
    a = [(r["id"], r["vector"]) for r in random_vectors(spark, 50, 6, partitions=1).orderBy("id").collect()]
    assert a == [(r["id"], r["vector"]) for r in random_vectors(spark, 50, 6, partitions=7).orderBy("id").collect()]
    assert a != [(r["id"], r["vector"]) for r in random_vectors(spark, 50, 6, seed=1).orderBy("id").collect()]


def test_log_round_trip_and_reopening(spark, tmp_path):
    p = str(tmp_path / "a.log")
    with recordlog.RecordLog(p) as log:
        assert [log.append(f"record_{i}".encode()) for i in range(10)] == list(range(10))
        assert len(log.read_all()) == 10
    with recordlog.RecordLog(p) as log:
        assert [d for _, _, d in log.read_all()] == [f"record_{i}".encode() for i in range(10)]
        assert log.append(b"") == 10
    recordlog.register(spark)
    rows = spark.read.format("recordlog").load(p).orderBy("rec_id").collect()
    assert [r["rec_id"] for r in rows] == list(range(11)) and bytes(rows[10]["data"]) == b""
    assert spark.read.format("recordlog").load(str(tmp_path)).count() == 11


def test_log_torn_and_corrupt_tails(tmp_path):
    p = str(tmp_path / "b.log")
    with recordlog.RecordLog(p) as log:
        for i in range(3):
            log.append(f"good_{i}".encode())
    with open(p, "ab") as f:
        f.write(os.urandom(30))
    with recordlog.RecordLog(p) as log:
        assert len(log.read_all()) == 3
        log.append(b"after")
        assert [d for _, _, d in log.read_all()][-1] == b"after"
    with open(p, "r+b") as f:
        f.seek(-1, 2)
        f.write(b"X")
    assert [d for *_, d, _ in recordlog.read_records(p)][-1] == b"good_2"
    assert len(list(recordlog.read_records(p, verify=False))) == 4
    open(p, "wb").write(b"abc")  # shorter than a header
    with recordlog.RecordLog(p) as log:
        log.append(b"x")
        assert len(log.read_all()) == 1
    plain = tmp_path / "p.log"  # a header of zeros
    recordlog.RecordLog(str(plain)).append(b"one")
    plain.write_bytes(bytes(8) + plain.read_bytes()[8:])
    with recordlog.RecordLog(str(plain)) as log:
        assert log.append(b"two") == 1 and [d for _, _, d in log.read_all()] == [b"one", b"two"]
    bad = tmp_path / "c.log"
    bad.write_bytes(b"notalogfile")
    with pytest.raises(ValueError):
        recordlog.RecordLog(str(bad))


def test_log_survives_a_kill(tmp_path):
    p = str(tmp_path / "d.log")
    code = f"import os,signal\nfrom sparvec.sources.recordlog import RecordLog\nl=RecordLog({p!r})\n[l.append(b'crash_%d' % i) for i in range(5)]\nos.kill(os.getpid(), signal.SIGKILL)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root})
    assert done.returncode == -signal.SIGKILL
    with recordlog.RecordLog(p) as log:
        assert [d for _, _, d in log.read_all()] == [b"crash_%d" % i for i in range(5)]


def test_log_stream(spark, tmp_path):
    p = str(tmp_path / "e.log")
    log = recordlog.RecordLog(p)
    log.append(b"one", 1.0)
    recordlog.register(spark)
    q = spark.readStream.format("recordlog").load(p).writeStream.format("memory").queryName("logged").start()
    try:
        q.processAllAvailable()
        log.append(b"two", 2.0)
        q.processAllAvailable()
        end = time.time() + 20
        while spark.table("logged").count() < 2 and time.time() < end:
            q.processAllAvailable()
        rows = spark.table("logged").orderBy("rec_id").collect()
    finally:
        q.stop()
    assert [bytes(r["data"]) for r in rows] == [b"one", b"two"] and len(rows[0]["checksum"]) == hashlib.sha256().digest_size


def test_substring_search(spark):
    docs = spark.createDataFrame([(2, "The cat"), (1, "a cat"), (3, None), (4, "dog")], "doc_id long, text string")
    s = DocumentSearch(docs)
    assert [r["doc_id"] for r in s.search("cat").collect()] == [1, 2]
    assert [r["doc_id"] for r in s.search("").collect()] == [1, 2, 4] and s.search("CAT").count() == 0
    more = s.add_documents(spark.createDataFrame([(5, "cat")], "doc_id long, text string"))
    assert more.search("cat").count() == 3


def test_stream_of_queries(spark, tmp_path):
    from sparvec.operators.exact import ExactIndex
    from sparvec.streaming.search import search_stream

    base = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vector array<float>")
    index = ExactIndex(2, base)
    src = str(tmp_path / "in")
    spark.createDataFrame([(7, [2.0, 0.1]), (8, [0.1, 2.0])], "query_id long, vector array<float>").write.parquet(src)
    stream = spark.readStream.schema("query_id long, vector array<float>").parquet(src)
    got = []
    q = search_stream(stream, lambda b: index.search(b, 1), lambda r, n: got.extend((x["query_id"], x["id"]) for x in r.collect()), str(tmp_path / "state"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(got) == [(7, 0), (8, 1)]
