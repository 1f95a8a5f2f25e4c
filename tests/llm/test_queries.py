"""The registered queries and the pipeline on the smallest tables, against brute force, plain patterns or SQL."""

import hashlib
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import lines, pii, queries, simhash

from .test_groups import blocked_groups, expected_cut, find

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, docs):
    from xxhash import xxh64_intdigest

    prints = {}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        h = [xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in prints}
    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op1_simhash")}
    assert got == {i: (f"{p:016x}", find(parent, i)) for i, p in prints.items()}


def test_op2(spark):
    turns = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn, r.role or "", r.text or "")):
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in run(spark, "op2_chat")}
    said = {i: "".join(t for role, t in own if role == "assistant") for i, own in turns.items()}
    assert got == {i: (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(said[i]), sha(said[i])) for i, own in turns.items()}


@pytest.mark.parametrize("name", ["op3_quality", "op4_language"])
def test_scores(spark, docs, name):
    rows = run(spark, name)
    assert sorted(r.doc_id for r in rows) == [r.doc_id for r in docs]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    if name == "op3_quality":
        assert all(r.predicted == (r.score >= 0.7) for r in rows)
    else:
        lettered = {r.doc_id for r in docs if any(c.isalpha() for c in r.text or "")}
        assert all((r.lang_pred == "und") == (r.doc_id not in lettered) for r in rows)


def test_op5(spark, docs):
    patterns = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    got = {r.doc_id: r for r in run(spark, "op5_secrets")}
    for d in docs:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns) for m in re.finditer(p, d.text or "", re.ASCII) if ok(m))
        r = got.pop(d.doc_id)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
        assert r.base_sha256 == sha(",".join(f"{patterns[k][0]}:{s}:{e}" for s, k, e in spans))
    assert not got


def test_op6(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    parent, links = {r.vec_id: r.vec_id for r in rows}, {r.vec_id: 0 for r in rows}
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([r.label for r in rows])[:, None] == np.array([r.label for r in rows])[None, :])
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = rows[i].vec_id, rows[j].vec_id
        links[a] += 1
        links[b] += 1
        p, q = find(parent, a), find(parent, b)
        parent[max(p, q)] = min(p, q)
    got = {r.vec_id: r for r in run(spark, "op6_embeddings")}
    assert set(got) == set(links)
    assert all(r.n_links <= links[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values())
    assert all(r.kept == (r.component_id == i) and find(parent, r.component_id) == find(parent, i) for i, r in got.items())


def test_op7(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op7_pii")}
    for d in docs:
        spans = pii.base_spans(d.text or "")  # held against the plain patterns in test_texts
        r = got.pop(d.doc_id)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in spans) for k in range(4))
        assert r.base_sha256 == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans))
    assert not got


def test_op8(spark, docs):
    from tidemark.llm import pieces

    with open(pieces.default_model(), "rb") as f:
        v = pieces.Vocabulary(f.read())
    got = {r.doc_id: r for r in run(spark, "op8_pieces")}
    assert set(got) == {d.doc_id for d in docs}
    for d in docs:
        r = got[d.doc_id]
        assert r.lossless == (d.text is not None)
        assert r.n_pieces == len(r.ids or [])
        if d.text is not None:
            assert pieces.decode_ids(v, np.array(r.ids, dtype=np.int64), np.array([len(r.ids)])) == [d.text.encode()]


def test_op9_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = queries.op9_decontamination(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op9_decontamination"]).fetchall()
    assert sorted(map(tuple, rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())) == sorted(want)


def test_op10(spark, docs):
    texts = [d.text or "" for d in docs]
    want = expected_cut(texts, blocked_groups(texts))
    got = {r.doc_id: r for r in run(spark, "op10_line_dedup")}
    assert {i: got[d.doc_id].text or "" for i, d in enumerate(docs)} == want
    assert all(got[d.doc_id].n_lines == (0 if d.text is None else d.text.count("\n") + 1) for d in docs)
    assert all(got[d.doc_id].n_gone == (d.text or "").count("\n") - want[i].count("\n") or want[i] == "" for i, d in enumerate(docs))


# --- the pipeline


def test_pipeline_stages(spark, docs):
    """Each stage on what the one before kept: columns, what goes and what stays."""
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, SF), name)
        rows = sorted(kept.collect(), key=lambda r: r.doc_id)
        ids = [r.doc_id for r in rows]
        was = {r.doc_id: r for r in before}
        assert set(ids) <= set(was)
        if name == "language_id":
            assert {i for i in was if i not in set(ids)} >= {i for i, r in was.items() if not any(c.isalpha() for c in r.text or "")}
            assert len(ids) >= 0.97 * len(was)
        elif name == "line_dedup":
            texts = [r.text for r in before]
            want = expected_cut(texts, blocked_groups(texts))
            assert {r.doc_id: r.text for r in rows} == {r.doc_id: want[i] for i, r in enumerate(before) if want[i].strip()}
            assert all(r.n_chars == len(r.text) for r in rows if r.text != was[r.doc_id].text)
        elif name == "simhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(before)).collect()}
            assert ids == sorted(set(groups.values()))
        elif name == "benchmark_decontamination":
            con = duckdb.connect()
            con.register("documents", spark.createDataFrame(before).toPandas())
            con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
            bad = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op9_decontamination']}) WHERE contaminated").fetchall()}
            assert bad
            assert ids == sorted(set(was) - bad)
        else:
            assert ids == sorted(was)
            assert all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns
        before = rows


def test_pipeline_of_odd_rows(spark, odd, none):
    """Nulls, empty and long texts, repeated rows and other columns go through; an empty table stays empty."""
    for start in (odd, none):
        kept = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.stored(stage(spark, kept, SF), name)
            assert kept.columns == start.columns
        out = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
        assert all(r.lossless for r in out)
        assert len(out) == (0 if start is none else len({r.doc_id for r in out}))
