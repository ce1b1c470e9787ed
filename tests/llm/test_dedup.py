import hashlib
import random
import re

import numpy as np
import pytest

from quillstack.llm import common, components, decontaminate, near_dups, queries, substrings

from .conftest import DOCS, edge_rows, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sf_docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def heavy(seed=5):
    """Copies, near copies, shared passages at shifting places, chains of near copies, repeats inside a text."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 150)
    docs = []
    for k in range(60):
        docs.append((k, prose(rng, rng.randint(0, 40)) + " " + passage + " " + prose(rng, rng.randint(0, 40))))
    chain = base.split()
    for k in range(60, 90):
        docs.append((k, " ".join(chain)))
        chain = list(chain)
        chain[rng.randrange(len(chain))] = f"c{k}"
    docs += [(90 + k, base.upper() if k % 2 else base) for k in range(20)]
    docs += [(120, passage + " " + passage), (121, " ".join(["same"] * 50)), (122, " ".join(["same"] * 30)), (123, "a b c d"), (124, "A  b c\nd"), (125, "a b c")]
    rng.shuffle(docs)
    return [(i, t, "en", "s", 1) for i, t in docs]


def brute_removed(rows, width=13):
    last = 1 << 63
    least = {}
    docs = [(last if r[0] is None else r[0], r[0], WORDS.findall(r[1] or "")) for r in rows]
    for d, _, w in docs:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            least[k] = min(d, least.get(k, last))
    out = []
    for d, i, w in docs:
        gone = {p for s in range(len(w) - width + 1) if least[tuple(w[s : s + width])] < d for p in range(s, s + width)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("stretch, bucket", [(700_000, 8 << 20), (300, 2000)])
def test_substrings(spark, edge, monkeypatch, stretch, bucket):
    for rows, df in ((edge_rows(), edge), (heavy(), spark.createDataFrame(heavy(), DOCS).repartition(5))):
        monkeypatch.setattr(substrings, "BUCKET_BYTES", bucket)
        got = sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=str)
        assert got == brute_removed(rows)
    assert substrings.remove_repeats(edge.limit(0)).count() == 0


def starts_of(data):
    return [first + k for first, n in np.frombuffer(data, "<i4").reshape(-1, 2).tolist() for k in range(n)]


def test_hot_bucket(spark, monkeypatch):
    """Buckets that are too large go on by whole windows, repeated doc_ids by a shuffle; the result is the same."""
    monkeypatch.setattr(substrings, "BUCKET_MOST", 2000)
    monkeypatch.setattr(substrings, "STRETCH_WORDS", 500)
    monkeypatch.setattr(common, "FEW", 0)
    rng = random.Random(9)
    rows = heavy() + [(3, prose(rng, 80), "", "", 1), (3, prose(rng, 80) + " " + heavy()[0][1], "", "", 1)]
    rows += [(300 + k, " ".join(w for n in range(40) for w in ("a b c d", f"v{rng.randrange(50)}")), "", "", 1) for k in range(40)]
    df = spark.createDataFrame(rows, DOCS).repartition(6).withColumnRenamed("lang", "nth").withColumnRenamed("source", "several")
    assert sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=str) == brute_removed(rows)


def test_stretches():
    """Small stretches leave more to the buckets; the marks are the same."""
    import pyarrow as pa

    rows = heavy()
    t = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows), pa.int64()), pa.array([r[1] for r in rows])], names=["doc", "nth", "text"])
    seen = []
    for size in (700_000, 500, 1):
        old, substrings.STRETCH_WORDS = substrings.STRETCH_WORDS, size
        marks, blobs = set(), {}
        for b in substrings._scatter(iter([t]), 7):
            for r in b.to_pylist():
                if r["doc"] is None:
                    blobs.setdefault(r["bucket"], []).append(r["data"])
                else:
                    marks |= {(r["doc"], p) for p in starts_of(r["data"])}
        for some in blobs.values():
            marks |= {(d, p) for _, d, _, data in substrings._bucket(some) for p in starts_of(data)}
        substrings.STRETCH_WORDS = old
        seen.append(marks)
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_substrings_query(spark):
    got = sorted((tuple(r) for r in queries.op7_substrings(spark, SF).collect()), key=str)
    assert got == brute_removed(sf_docs(spark))


def brute_groups(rows):
    sets = []
    for r in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        w = WORDS.findall(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(rows[i][0]), find(rows[j][0])
                parent[max(p, q)] = min(p, q)
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r, s in zip(rows, sets)), key=str)


def test_near_dups(spark, edge):
    rows = edge_rows()
    got = sorted((tuple(r) for r in near_dups.near_duplicates(edge).collect()), key=str)
    want = brute_groups(rows)
    # The row without an id has no component, as stated.
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
    assert near_dups.near_duplicates(edge.limit(0)).count() == 0
    rows = heavy()
    got = sorted((tuple(r) for r in near_dups.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).collect()), key=str)
    assert got == brute_groups(rows)


@pytest.mark.parametrize("few", [0, 100])
def test_repeated_ids(spark, monkeypatch, few):
    """Rows that share a doc_id are one node with the links of all its texts; hot centres are dealt out."""
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(near_dups, "FEW", few)
    monkeypatch.setattr(near_dups, "NODES", few)
    monkeypatch.setattr(near_dups, "PART", 3)
    rng = random.Random(8)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(3, b), (5, a), (5, b), (9, a), (8, c), (5, ""), (2, None), (2, c + " more"), (4, c), (20, ""), (20, "x y"), (20, "x y"), (None, a), (None, b)]
    rows += [(100 + k, f"{a} tail {k}") for k in range(12)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, several int").repartition(3)
    got = sorted((tuple(r) for r in near_dups.near_duplicates(df).collect()), key=str)
    want = brute_groups(rows)
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
    assert {g[2:] for g in got if g[0] is None} == {(None, True)} and {w[2] for w in want if w[0] == 5} == {3}


def near_family(n=40):
    """Copies of one text with one to five words changed: some are linked to each other, some only nearly."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(100), 1 + i % 5):
            words[at] = f"x{i}y{at}" if i % 3 else f"z{at}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("rare", [1, 4])
def test_near_dups_across(spark, monkeypatch, rare):
    """Without star rounds every link comes from the bounded pairs across components."""
    monkeypatch.setattr(near_dups, "STARS", 0)
    monkeypatch.setattr(near_dups, "RARE", rare)
    rows = near_family()
    want = brute_groups(rows)
    assert 1 < len({w[2] for w in want}) < len(rows)
    got = sorted((tuple(r) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == want


def brute_components(links):
    least = {x: x for link in links for x in link}
    while True:
        now = dict(least)
        for a, b in links:
            now[a] = now[b] = min(now[a], now[b])
        if now == least:
            return sorted((x, c) for x, c in least.items() if x != c)
        least = now


@pytest.mark.parametrize("portion", [100_000, 40, 3])
def test_components(spark, monkeypatch, portion):
    """Few links are finished by one task, without rounds; many take rounds, until few are left or nothing changes."""
    calls = []
    monkeypatch.setattr(components, "stored", lambda df, tag: calls.append(tag) or common.stored(df, tag))
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(k + 1, k) for k in range(100, 130)] + [(-5, -9), (7, 7), (8, 200), (200, 8)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(links)
    monkeypatch.setattr(components, "PORTION", portion, raising=False)
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(9))
    assert sorted(tuple(r) for r in got.collect()) == brute_components(links)
    assert portion < len(links) or len(calls) == 1
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_band(spark, monkeypatch):
    """Rounds don't deal the members of few bands by band, so those of a crowded band stay spread; results are the same either way."""
    plans = []

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString() if tag in ("pool", "mixed") else "")
        return common.stored(df, tag)

    monkeypatch.setattr(near_dups, "stored", seen)
    rows = near_family()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted((tuple(r) for r in near_dups.near_duplicates(df).collect()), key=str)
        assert got == brute_groups(rows)
        # The middles are gathered by band; the members, the other side of the join, aren't.
        assert any(plans) and all(len(re.findall(r"Exchange hashpartitioning\(band", p)) <= 1 for p in plans)
        monkeypatch.setattr(near_dups, "FEW", 0)
        assert sorted((tuple(r) for r in near_dups.near_duplicates(df).collect()), key=str) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_near_dups_query(spark):
    got = sorted((tuple(r) for r in queries.op8_near_dups(spark, SF).collect()), key=str)
    assert got == brute_groups(sf_docs(spark))


def test_signature_estimates():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.9):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 200).astype(np.uint64)
            n = round(200 * share)
            half = n + (200 - n) // 2
            a, b = pool[:half], np.concatenate([pool[:n], pool[half:]])
            s = near_dups.signatures([a, b])
            errors.append((s[0] == s[1]).mean() - n / 200)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def brute_hits(rows, items, width=13):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: cut.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        found.discard(None)
        out.append((r[0], len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [100_000, 1])
def test_contamination(spark, edge, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(2)
    items = [(1, prose(rng, 30)), (2, prose(rng, 14)), (3, "KK ß-É"), (4, None), (5, ""), (6, "one Two"), (7, prose(rng, 30)), (12, "same " * 20), (13, "SAME " * 16), (None, prose(rng, 20)), (3, "one two")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    rows = edge_rows() + [(500 + k, f"{prose(rng, k)} {items[k % 3 * 3][1]} {prose(rng, 9 * k)}", None, "s", 0) for k in range(12)]
    rows += [(600, "kK, ß;É", "", "", 1), (601, "the\x00ONE--two" + " same" * 40, "", "", 1), (602, " ".join(items[0][1].split()[3:17]) + " " + " ".join(items[0][1].split()[5:25]), "", "", 1), (603, items[9][1], "", "", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "n_hit").withColumnRenamed("source", "__hit").withColumnRenamed("n_chars", "__DOC")
    got = decontaminate.contamination(df, bench).select("doc_id", *decontaminate.RESULT)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_hits(rows, items)
    assert decontaminate.contamination(edge.limit(0), bench).count() == 0
    none = decontaminate.contamination(edge, bench.limit(0)).select("doc_id", *decontaminate.RESULT)
    assert sorted((tuple(r) for r in none.collect()), key=str) == brute_hits(edge_rows(), [])


def test_contamination_query(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op9_decontamination(spark, SF).select("doc_id", *decontaminate.RESULT)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_hits(sf_docs(spark), items)
