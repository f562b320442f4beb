"""Host rules, source audit and periodic runs: whole queries against SQL or plain loops, with odd rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import host_rules, periodic_runs, queries, source_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["".join(np.random.default_rng(k).choice(list("abcdefghijklmnop"), 4)) for k in range(60)]


def corpus(spark, folder, n=150, clash=()):
    rng = np.random.default_rng(8)
    text = lambda k, some: " ".join(rng.choice(WORDS[:some], k))
    rows = [(k, text(int(rng.integers(1, 120)), 60), ("en", "fr", None)[k % 3], ("a", "b", "c", None, "https://u@Host.org:80/x")[k % 5], 1) for k in range(n)]
    rows += [(200 + k, text(80, 3), "en", "a", 1) for k in range(12)]  # few words: many repeated windows
    rows += [(300, None, None, None, None), (301, "", "en", "empty", 0), (302, " \t\n\x0b\x0c\r ", "en", "a", 1), (303, "é É ß 中文 中文 x y", "fr", "b", 1), (None, "one two one two one two one two", "fr", "a", 1)]
    rows += [(304, "a b c d e\nline two\nline two\n  \nline two\n\n", "en", "b", 1), (305, "x " * 30_000, "en", "c", 1), (306, "#$% <a> & b*c|d", "en", "c", 1), rows[3], rows[3], (307, "a  b\tc d e a b c d e", "solo", "z", 1)]
    rows += [(400 + k, " ".join(WORDS[k % 7 : k % 7 + 3]) + " " + "loop de " * (k % 6) + "end", "en", "b", 1) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in clash:
        df = df.withColumn(c, F.lit(1))
    df.write.parquet(f"{folder}/documents.parquet")
    return rows


def sql(folder, text):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return sorted(map(repr, con.execute(f"select * from ({text}) order by all").fetchall())), [c[0] for c in con.description]


@pytest.mark.parametrize("name", ["op11_host_rules", "op12_source_audit"])
def test_query_equals_sql(spark, tmp_path, name):
    corpus(spark, tmp_path, clash=("host", "w", "h", "s", "t", "n_words", "rejected", "salt", "term", "value", "chunk", "a.b"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    want, columns = sql(tmp_path, queries.ORACLES[name])
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op11_host_rules", "op12_source_audit", "op13_periodic_runs"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_host_verdicts(spark):
    good, bad = " ".join(WORDS[:20]), "too short"
    rows = [(k, good if k % 10 else bad, "large") for k in range(200)] + [(300 + k, bad, "bad") for k in range(40)] + [(400, bad, "tiny"), (401, good, None), (402, bad, None)]
    rows += [(500 + 20 * h + k, good if k else bad, f"h{h}") for h in range(12) for k in range(20)] + [(340, good, "bad")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in host_rules.judge(df).collect()}
    assert len(out) == len(rows) and out[340].host_rejected and not out[340].kept and not out[340].base_failed
    assert out[1].kept and not out[0].kept and out[401].kept and not out[402].kept
    found = {r.host: r for r in host_rules.verdicts(host_rules.measure(df)).collect()}
    assert found["bad"].rejected and not found["tiny"].rejected and found["tiny"].rate_too_short < 0.5 < found["bad"].rate_too_short
    assert found["large"].rate_too_short == pytest.approx(0.1, abs=0.02) and found["bad"].n_docs == 41
    salted = {r.doc_id: r for r in host_rules.judge(df, broadcast_hosts=0).collect()}
    assert salted == out


def test_host_of_urls(spark):
    rows = [("http://A.example/x?y#z", "a.example"), ("https://me:pw@b.example:81", "b.example"), ("Plain", "plain"), (None, None), ("", ""), ("ftp://", "ftp://")]
    got = spark.createDataFrame(rows, "source string, want string").select(host_rules.host(F.col("source")).alias("host"), "want").collect()
    assert all(r.host == r.want for r in got)


@pytest.mark.parametrize(("chunk", "block", "stripe"), [(1, 1, 1), (5, 2, 3), (1000, 100, 100)])
def test_audit_in_any_blocks(spark, tmp_path, chunk, block, stripe):
    corpus(spark, tmp_path, 60)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want, columns = sql(tmp_path, source_audit.ORACLE)
    got = source_audit.audit(df, chunk=chunk, block=block, stripe=stripe).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == want


def test_weights_are_exact(spark):
    """Values beyond 64 bits in the weights' numerator stay exact."""
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, v long")
    p = df.select(source_audit.weight(F.col("n"), F.col("total"), F.col("v")).alias("p")).first().p
    assert p == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7)


def plain_runs(w, least=6, e=4):
    out, n = [], len(w)
    for q in range(1, n // e + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            seg = w[s : s + length]
            if length >= max(least, e * q) and not any(seg[d:] == seg[:-d] for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    some = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *some, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_query(spark, tmp_path):
    rows = [r for r in corpus(spark, tmp_path, clash=("runs", "collapsed", "w", "p", "t", "a.b")) if r[0] != 305]
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = [plain_row(r[0], r[1]) for r in rows]
    assert sorted(map(repr, (r for r in got if r[0] != 305))) == sorted(map(repr, want))
    assert sum(r[1] for r in want) >= 20 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    long_ = next(r for r in got if r[0] == 305)
    assert long_[1:6] == (1, 0, 30_000, 1, 30_000_000)


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_plain_loops(seed):
    rng = np.random.default_rng(seed)
    for t in range(120):
        n, k = int(rng.integers(0, 70)), int(rng.integers(1, 6))
        w = [str(x) for x in rng.integers(0, k, n)]
        if t % 3 == 0 and n:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, 9))
            w = [w[i] if i < a or i < a + p else w[a + (i - a) % p] for i in range(n)]
        for least, e in ((6, 4), (2, 2), (5, 3)):
            want = plain_runs(w, least, e)
            assert periodic_runs.runs_of(np.array(w, dtype=np.int64), least, e) == want
            _, runs, _ = periodic_runs._of_rows(pa.array([" ".join(w), None, "7 " + " ".join(w)]), least, e)
            assert [(r["start"], r["length"], r["period"]) for r in runs[0]] == want and not runs[1]


def test_extensions_do_not_rest_on_hashes(monkeypatch):
    """With hashes that collide all the time, what is found stays right: the words themselves are compared."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: np.ones(len(x), np.uint64))
    rng = np.random.default_rng(5)
    for _ in range(200):
        w = rng.integers(0, 3, int(rng.integers(1, 40)))
        assert periodic_runs.runs_of(w, 2, 2) == plain_runs(w.tolist(), 2, 2)


def test_long_loops_cost_little():
    rng = np.random.default_rng(9)
    w = np.tile(rng.integers(0, 40, 3000), 40)
    assert (0, 120_000, 3000) in periodic_runs.runs_of(w)
    assert periodic_runs.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
