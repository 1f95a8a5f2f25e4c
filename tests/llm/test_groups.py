import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import embeddings, lines, simhash
from tidemark.llm.components import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    from xxhash import xxh64_intdigest

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_the_definition(odd):
    want = {(r.doc_id, brute_print(r.text)) for r in odd.select("doc_id", "text").collect()}
    assert {(r.doc_id, r.fp & (2**64 - 1)) for r in simhash.fingerprints(odd).collect()} == want


@pytest.mark.parametrize("hot", [10_000, 0, 3])
def test_links_of_two_bits(spark, hot):
    """All three ways of a half: in the join, listed, and mixed."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)} | {0, 1, 2**64 - 1})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if 0 < ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot).collect()}
    assert got == want
    assert want


@pytest.mark.parametrize("hot", [10_000, 0])
def test_links_do_not_broadcast_exploded_rows(spark, hot):
    """Their size is estimated as before the explosion: 33 rows of each fingerprint went to the driver."""
    found = simhash.links(spark.range(1000).select(F.xxhash64("id").alias("fp")), hot)
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    joins = [i for i, x in enumerate(plan) if "BroadcastHashJoin" in x and "LeftAnti" not in x]
    assert any("SortMergeJoin" in x for x in plan)
    for i in joins:
        below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
        assert not any("Generate" in x for x in plan[i + 1 : below])


def test_simhash_odd_rows(odd, none, same_ids):
    out = simhash.near_duplicates(odd)
    same_ids(out)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in out.collect()}
    assert {c for i, _, c in got if i in (1, 2)} == {1}
    assert (3, "0" * 16, 3) in got
    assert (4, "0" * 16, 3) in got
    assert (None, "0" * 16, 3) in got
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(odd, none):
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 6, 7, 8, 9, 10, 11]
    assert ids.count(None) == 1
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("abc", "", 3), ("kitten", "sitting", 3), ("flaw", "lawn", 2), ("abcdef", "abXdef", 1), ("aaaa", "aa", 2)])
def test_edit_distance(a, b, d):
    assert lines.edit_distance(a, b) == d


def test_edit_distance_equals_a_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert lines.edit_distance(a, b) == row[-1]
        for most in (0, 2, 5):
            assert (lines.edit_distance(a, b, most) <= most) == (row[-1] <= most)


WORDS = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "con", "sec", "te") for b in ("em", "sum", "or", "a", "et", "tur", "ad", "i")]


def parsed(texts):
    return lines.Lines(pa.array(texts, pa.string()))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\r\x0b\x0cé日.", max_size=40)), max_size=6))
def test_lines_in_normal_form(texts):
    want = [(i, j, b" ".join(line.split())) for i, t in enumerate(texts) if t is not None for j, line in enumerate(t.encode().lower().split(b"\n")) if line.split()]
    got = parsed(texts)
    assert list(zip(got.text.tolist(), got.pos.tolist(), got.each(), strict=True)) == want
    some = np.arange(0, len(got), 2)
    assert list(got.take(some).each()) == [w[2] for w in want][::2]
    if want:
        assert lines._chars(got).tolist() == [len(w[2].decode()) for w in want]


def test_blocks_do_not_depend_on_the_batch():
    rng = random.Random(1)
    rows = [" ".join(rng.choices(WORDS, k=rng.randint(1, 300))) for _ in range(40)]
    who, key = lines.block_keys(parsed(["\n".join(rows)]))
    for i, row in enumerate(rows):
        assert sorted(key[who == i].tolist()) == sorted(lines.block_keys(parsed([row]))[1].tolist())


def blocked_groups(texts):
    """Brute force over all pairs of different lines: those that share a block, may be near and are similar link."""
    all_ = parsed(texts)
    at = {t: i for i, t in reversed(list(enumerate(all_.each())))}
    who, key = lines.block_keys(all_)
    words, pairs = lines.fingerprints(all_)
    own = {t: set(key[who == i].tolist()) for t, i in at.items()}
    bits = lambda x, a, b: (int(x[at[a]]) ^ int(x[at[b]])).bit_count()
    parent = {t: t for t in own}
    for a, b in combinations(own, 2):
        short = min(all_.n_words[at[a]], all_.n_words[at[b]]) < lines.SHORT
        if own[a] & own[b] and (short or (bits(words, a, b) <= lines.FAR_BITS and bits(pairs, a, b) <= lines.FAR_PAIRS)) and lines.similar(a.decode(), b.decode()):
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    return {t: find(parent, t) for t in own}


def expected_cut(texts, roots):
    all_ = parsed(texts)
    seen, gone = set(), {}
    for d, pos, t in zip(all_.text.tolist(), all_.pos.tolist(), all_.each(), strict=True):
        if roots[t] in seen:
            gone.setdefault(d, set()).add(pos)
        seen.add(roots[t])
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in enumerate(texts)}


@pytest.mark.parametrize(("part", "pairs", "broadcast"), [(2000, 10**9, 10**6), (3, 0, 0), (2, 0.25, 10**6)])
def test_lines_equal_brute_force(spark, monkeypatch, part, pairs, broadcast):
    """Pairs at once, rounds first, and blocks in parts of two lines; texts fetched by broadcast keys and by shuffle."""
    for name, value in (("PART", part), ("PAIRS_A_LINE", pairs), ("BROADCAST_KEYS", broadcast)):
        monkeypatch.setattr(lines, name, value)
    rng = random.Random(4)
    base = [rng.choices(WORDS, k=rng.randint(1, 60)) for _ in range(20)]
    texts = []
    for _ in range(70):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            kind = rng.random()
            if kind < 0.5:
                for _ in range(rng.randint(1, 3)):
                    line[rng.randrange(len(line))] = rng.choice(WORDS)
            elif kind < 0.6:
                rng.shuffle(line)
            own.append(" ".join(line).upper() if kind > 0.9 else "  ".join(line))
        texts.append("\n".join(own))
    roots = blocked_groups(texts)
    assert 20 < len(set(roots.values())) < len(roots)
    out = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == expected_cut(texts, roots)


def test_lines_of_the_same_words_in_other_orders(spark):
    """Thousands of orders of one line's words are different lines, and their pairs are not all tested."""
    rng = random.Random(8)
    words = [w + v for w, v in zip(WORDS[:14], WORDS[20:34], strict=True)]
    rows = {" ".join(rng.sample(words, len(words))) for _ in range(20_000)}
    docs = spark.createDataFrame(list(enumerate(sorted(rows))), "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    assert lines.dedup_lines(docs).where("__tm_gone > 0").count() < 0.05 * len(rows)
    assert time.perf_counter() - began < 120


def test_lines_around_one_passage(spark, monkeypatch):
    """Lines that share a passage and are near, but not similar, meet in cells: their pairs are not written. The few copies with a changed word still link."""
    monkeypatch.setattr(lines, "PART", 64)
    rng = random.Random(11)
    passage = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60)]
    texts = [" ".join(passage + [rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(36)]) for _ in range(120)]
    texts += [t.replace(passage[7], "changed", 1) for t in texts[:10]]
    written, real = [], lines.stored

    def stored(df, what):
        out = real(df, what)
        if what in ("pairs", "more", "star"):
            written.append(out.count())
        return out

    monkeypatch.setattr(lines, "stored", stored)
    roots = blocked_groups(texts)
    assert len(set(roots.values())) > 100
    out = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == expected_cut(texts, roots)
    assert max(written) < 10 * len(texts)


def test_bounds_keep_the_right_side():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 6)))
    x, y = [], []
    for _ in range(400):
        a = [word() for _ in range(rng.randint(1, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            kind, at = rng.random(), rng.randrange(len(b))
            b[at : at + 1] = [word()] if kind < 0.5 else [b[at], word()] if kind < 0.75 else [] if len(b) > 1 else b[at : at + 1]
        x.append(" ".join(a))
        y.append(" ".join(b))
    right = np.array([lines.similar(a, b) for a, b in zip(x, y, strict=True)])
    may = lines._may_be_similar(x, y)
    assert not (right & ~may).any()
    exact = np.array([lines.edit_distance(a, b) for a, b in zip(x, y, strict=True)])
    allowed = np.array([int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in zip(x, y, strict=True)])
    assert (right == (exact <= allowed)).all()
    upper = np.array([lines._at_most(*lines._trimmed(a, b))[0] for a, b in zip(x, y, strict=True)])
    assert (upper >= exact).all()
    assert (upper <= allowed)[right].mean() > 0.9


def test_line_keys_that_clash(spark, monkeypatch, tmp_path):
    """With keys of few bits many lines clash, and are still told apart."""
    real = lines.line_keys

    def narrow(found, taken=()):
        key, check = real(found)
        key = key & np.uint64(15)
        for r, some in enumerate(taken):
            again = np.isin(key, some.view(np.uint64))
            key[again] = check[again] if r else check[again] & np.uint64(1023)
        return key, check

    texts = [f"{a} stands by {b}\n{b}" for a, b in zip(WORDS[:30], reversed(WORDS), strict=False)]
    source = lines._Source(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    source.keys = narrow
    found, each = source.places()
    assert source.taken
    assert each.count() == len({line for t in texts for line in t.split("\n")})
    assert each.where("low != high").count() == 0
    assert found.count() == 60


def test_recall_of_similar_lines():
    """Share of pairs of edit similarity 0.8 or more that share a block, a tenth of the words changed."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    for n, least in ((12, 0.9), (20, 0.95), (40, 0.95), (100, 0.95), (300, 0.95)):
        met = tried = 0
        for _ in range(150):
            line = [word() for _ in range(n)]
            other = list(line)
            for at in rng.sample(range(n), max(1, n // 10)):
                other[at] = word()
            a, b = " ".join(line), " ".join(other)
            if lines.similar(a, b):
                tried += 1
                met += len(np.intersect1d(lines.block_keys(parsed([a]))[1], lines.block_keys(parsed([b]))[1])) > 0
        assert met >= least * tried > 0


def test_similarity_of_very_long_lines():
    """A bound decides near copies of over a million characters; exact distances agree with it on shorter ones."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    line = [word() for _ in range(200_000)]
    near = [word() if rng.random() < 0.02 else w for w in line]
    began = time.perf_counter()
    assert lines.similar(" ".join(line), " ".join(near))
    assert time.perf_counter() - began < 30
    for share in (0.0, 0.05, 0.15, 0.2, 0.25, 0.5, 0.9):
        a = [word() for _ in range(500)]
        b = [word() if rng.random() < share else w for w in a]
        a, b = " ".join(a), " ".join(b)
        exact = lines.edit_distance(a, b)
        assert exact <= lines._at_most(a, b)[0]
        assert lines.similar(a, b) == (exact <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_distances_of_many_pairs():
    rng = random.Random(3)
    xs, ys = [], []
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh ", "äß日a"])
        x = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 200])))
        y = "".join(c if rng.random() < 0.8 else rng.choice(["", c + "a", "b"]) for c in x) if rng.random() < 0.8 else "".join(rng.choices(letters, k=rng.randint(0, 150)))
        xs.append(x)
        ys.append(y)
    assert lines._distances(xs, ys).tolist() == [lines.edit_distance(x, y) for x, y in zip(xs, ys, strict=True)]
    assert lines._distances([], []).tolist() == []


def test_pairs_are_measured_together(monkeypatch):
    """Lines of the same words in other orders took a distance for every gap, one by one: most of op10's time."""
    rng = random.Random(8)
    pairs = []
    for n in rng.choices((5, 20, 60), k=600):
        line = rng.choices(WORDS, k=n)
        other = list(line)
        if rng.random() < 0.5:
            rng.shuffle(other)
        else:
            other[rng.randrange(n)] = "é" * rng.randint(1, 20)
        pairs.append((" ".join(line), " ".join(other)))
    pairs += [("", ""), ("same", "same"), ("", "x" * 2000), ("x" * 5000, "x" * 2500 + "y" * 900 + "x" * 1600), ("a " * 900, "b " * 900)]
    xs, ys = zip(*pairs, strict=True)
    want = [lines.similar(x, y) for x, y in pairs]
    plain, calls = lines.edit_distance, []
    monkeypatch.setattr(lines, "edit_distance", lambda *a: calls.append(a) or plain(*a))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(xs))), pa.array(range(len(xs))), pa.array(xs), pa.array(ys)], ["a", "b", "x", "y"])
    got = [ok for b in lines._verify(iter([batch])) for ok in b.column("ok").to_pylist()]
    assert got == want
    assert 100 < sum(want) < 500
    assert len(calls) < len(pairs) / 4


def test_limits_of_many_distances():
    """With limits, distances up to them are exact, and others are over them; blocks of rows, pairs left out on the way, letters of any width."""
    rng = random.Random(8)
    xs, ys = [], []
    for _ in range(600):
        a = rng.choices("abcd é日\U0001f600" if rng.random() < 0.5 else "abcdefgh ", k=rng.choice([1, 40, 64, 65, 130, 300, 520]))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // rng.choice([1, 4, 12]) + 1)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 2)] = rng.choices("abxyz ", k=rng.randint(0, 2))
        xs.append("".join(a))
        ys.append("".join(b))
    most = [max(len(a), len(b)) // 5 for a, b in zip(xs, ys, strict=True)]
    want = [lines.edit_distance(x, y) for x, y in zip(xs, ys, strict=True)]
    got = lines._distances(xs, ys, most).tolist()
    assert all(g == d if d <= k else g > k for g, d, k in zip(got, want, most, strict=True))
    assert 100 < sum(d <= k for d, k in zip(want, most, strict=True)) < 500


def test_one_passage_replaced_is_never_far():
    """Its distance is its length at most, though the words it shares with the other lie at its other end, and its gaps sum up to more."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    head, old, new = ([word() for _ in range(n)] for n in (160, 30, 30))
    a, b = (" ".join([*head, *part]) for part in ([*old, "zebra"], ["zebra", *new]))
    x, y = lines._trimmed(a, b)
    allowed = int(0.2 * max(len(a), len(b)) + 1e-9)
    assert max(len(x), len(y)) <= allowed < lines._at_most(x, y)[0] / lines.SLACK
    assert lines.similar(a, b) and lines.similar_pairs([a], [b]).tolist() == [True]


def test_long_texts_of_few_words_are_bounded(monkeypatch):
    """No word comes once, yet runs of words do: the whole distance is not taken."""
    rng = random.Random(10)
    a = rng.choices("the of and in to was for with".split(), k=2000)
    b = [w if i % 100 else "new" for i, w in enumerate(a)]
    whole, plain = [], lines.edit_distance
    monkeypatch.setattr(lines, "edit_distance", lambda x, y, *most: whole.append(len(x)) or plain(x, y, *most))
    assert lines.similar(" ".join(a), " ".join(b))
    assert max(whole, default=0) < 1000


def test_keys_of_texts_are_not_sorted_for_every_batch(monkeypatch):
    """Texts of candidate lines are found by bisection in the sorted keys."""
    texts = [f"line number {i} of some text that is here" for i in range(50)]
    key = lines.line_keys(parsed(texts))[0].view(np.int64)
    monkeypatch.setattr(np, "isin", None)
    held = type("Held", (), {"value": np.sort(key[::2])})
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [k for b in lines._texts_of([], held)(iter([batch])) for k in b.column("key").to_pylist()]
    assert sorted(got) == sorted(key[::2].tolist())
    held.value = held.value[:0]
    assert list(lines._texts_of([], held)(iter([batch]))) == []


def test_shared_blocks_equal_a_dictionary(monkeypatch):
    """Blocks go to their buckets many in a row; of those that several lines share, each line comes once, with the least key."""
    monkeypatch.setattr(lines, "HELD", 64)
    rng = random.Random(11)
    texts = [" ".join(rng.choices("red blue green black white".split(), k=rng.randint(1, 9))) for _ in range(300)]
    texts += ["x" * 70_000, "x" * 70_000 + "y " + "z" * 140_000, " ".join(["same words again"] * 40)] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    packed = [b for part in (batch.slice(0, 150), batch.slice(150), batch.slice(100, 50)) for b in lines._blocks_of([], 5)(iter([part]))]
    rows = pa.Table.from_batches(packed).sort_by("bucket")
    got = [r for b in lines._shared(iter(rows.to_batches(max_chunksize=3))) for r in zip(*(b.column(c).to_pylist() for c in ("block", "key", "rep")), strict=True)]
    all_ = parsed(texts)
    key = lines.line_keys(all_)[0].view(np.int64).tolist()
    under: dict = {}
    for i, block in zip(*(x.tolist() for x in lines.block_keys(all_)), strict=True):
        under.setdefault(int(np.uint64(block).view(np.int64)), set()).add(key[i])
    assert sorted(got) == sorted((b, k, min(ks)) for b, ks in under.items() if len(ks) > 1 for k in ks)
    assert list(lines._shared(iter([]))) == []


def test_lines_odd_rows(odd, none, same_ids):
    out = lines.dedup_lines(odd)
    same_ids(out)
    assert out.columns[:-2] == odd.columns
    got = {r.doc_id: r for r in out.collect() if r.doc_id}
    assert got[1].text.count("\n") == 1
    assert got[1]["__tm_gone"] == 0
    assert (got[2].text, got[2]["__tm_gone"], got[2]["__tm_left"]) == ("", 2, False)
    assert got[3].text is None
    assert got[5].text == "   \n\t\n "
    assert lines.dedup_lines(none).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(30):
            v = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((n, [float(x) for x in (v + rng.normal(size=16) * rng.choice([0, 0.02, 0.05]))], label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), (n + 3, None, 0), (n + 4, [0.0] * 16, 0), (n + 5, [float("nan")] * 16, 0), (n + 6, rows[0][1], None), (n + 7, [1.0, 2.0], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [None, 1.0], 0), (n + 10, [], 0), (n + 11, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    import pandas as pd

    exact = {r.vec_id: None if r.embedding is None else np.array([np.nan if x is None else x for x in r.embedding], dtype=np.float64) for r in df.collect()}
    ok = {i: v for i, v in exact.items() if v is not None and len(v) and np.isfinite(v).all() and v.any() and dict((a, c) for a, _, c in rows)[i] is not None}
    label = {a: c for a, _, c in rows}
    links = {i: 0 for i in exact}
    parent = {i: i for i in exact}
    for i in ok:
        for j in ok:
            if i < j and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    for block in (256, 2):
        got = embeddings.near_duplicates(df, block=block).toPandas().set_index("vec_id")
        assert len(got) == len(rows)
        assert all(got.n_links[i] <= links[i] for i in links)
        assert got.n_links.sum() >= 0.9 * sum(links.values())
        same = pd.Series({i: got.component_id[i] == find(parent, i) for i in links}).mean()
        assert same >= 0.95
        assert (got.kept == (got.component_id == got.index)).all()
    assert embeddings.near_duplicates(df.where("false")).count() == 0
    assert embeddings.near_duplicates(df.withColumn("node", F.lit(1)).withColumn("n", F.lit(2))).count() == len(rows)
