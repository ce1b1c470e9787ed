import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstack.llm import line_chunks, neighbours, quality, queries

from .conftest import DOCS, edge_rows, prose
from .test_dedup import brute_groups, brute_hits

SF = "/root/testdata/sf0.001"


def test_chunks_resist_shifts():
    lines = [f"line {k}".encode() for k in range(400)]
    whole = {tuple(lines[a : a + n]) for a, n in line_chunks.chunks(lines)}
    more = lines[:100] + [b"new"] + lines[100:]
    moved = {tuple(more[a : a + n]) for a, n in line_chunks.chunks(more)}
    assert len(whole & moved) >= 0.9 * len(whole)
    for text in (lines, more, lines[:1], [b"x"] * 100):
        parts = line_chunks.chunks(text)
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) == len(text)


def brute_removed(spark_rows):
    """First occurrence by (doc_id, hash of the text, line) of each chunk's bytes; keys as Spark hashes them."""
    first = {}
    cut = []
    for doc, key, text in spark_rows:
        lines = (text or "").encode().split(b"\n")
        parts = [(a, n, b"\n".join(lines[a : a + n])) for a, n in line_chunks.chunks(lines)] if len(lines) > 1 else []
        parts = [p for p in parts if p[1] > 1 and p[2].strip()]
        cut.append((doc, key, text, lines, parts))
        for a, _, part in parts:
            at = (line_chunks.LAST if doc is None else doc, key, a)
            first[part] = min(first.get(part, at), at)
    out = []
    for doc, key, text, lines, parts in cut:
        gone = {k for a, n, part in parts if first[part] != (line_chunks.LAST if doc is None else doc, key, a) for k in range(a, a + n)}
        kept = None if text is None else b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode()
        out.append((doc, kept, 0 if text is None else len(lines), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few, stretch", [(200_000, 8 << 20), (0, 300)])
def test_remove_chunks(spark, edge, monkeypatch, few, stretch):
    monkeypatch.setattr(line_chunks, "FEW", few)
    monkeypatch.setattr(line_chunks, "STRETCH_BYTES", stretch)
    rng = random.Random(4)
    block = "\n".join(prose(rng, 8).replace("\n", " ") for _ in range(12))
    rows = [(k, "\n".join([prose(rng, 6) for _ in range(k % 4)] + [block] * (1 + k % 2) + [prose(rng, 5)]), "x", "y", 1) for k in range(40)] + [(7, "\n \n\t\n\n", "", "", 1), (8, "\n \n\t\n\n", "", "", 1), (None, block, "", "", 1)] + edge_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(4).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "__marks").cache()
    keyed = df.selectExpr("doc_id", "xxhash64(text) k", "text").collect()
    got = line_chunks.remove_chunks(df)
    assert got.columns == ["doc_id", "text", "__marks", "n_chars", "n_lines", "n_removed"]
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == brute_removed(keyed)
    assert line_chunks.remove_chunks(edge.limit(0)).count() == 0


def test_gradient_and_order():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 900)
    tokens = [np.unique(np.concatenate([rng.integers(0, 400, 30), [1000 + g] * (rng.random() < 0.9)])).astype(np.uint32) for g in grades]
    dense = rng.normal(size=(900, quality.MEASURES)) + grades[:, None] * 0.1
    model = quality.fit(grades[:600], tokens[:600], dense[:600])
    assert (np.diff(model.thresholds) > 0).all()
    x = np.clip((dense[600:] - model.mean) / model.scale, -6, 6)
    score = np.array([sum(model.weights.get(int(h), 0.0) for h in t) for t in tokens[600:]]) + x @ model.dense
    expected, tail = model.grades(score)
    assert ((tail >= 0.5) == (grades[600:] == 2)).mean() > 0.85 and np.corrcoef(expected, grades[600:])[0, 1] > 0.8
    assert quality.fit(np.ones(5, int), tokens[:5], dense[:5]) is None


def test_slope():
    """The gradient against differences of the loss."""
    rng = np.random.default_rng(4)
    grades, x = rng.integers(0, 3, 40), rng.normal(size=(40, 3))
    row, index = rng.integers(0, 40, 90), rng.integers(0, 5, 90)
    p = rng.normal(size=10) * 0.3
    _, g = quality.slope(p, row, index, x, grades)
    for k in range(len(p)):
        step = np.eye(len(p))[k] * 1e-6
        assert abs((quality.slope(p + step, row, index, x, grades)[0] - quality.slope(p - step, row, index, x, grades)[0]) / 2e-6 - g[k]) < 1e-7


def plain_quality(docs, labels):
    """The operator in plain loops: features, choice of hashes, proximal Adam and scores of all documents."""
    import math

    import xxhash

    def parts(token):
        word = token.strip(quality._MARKS) or token
        return [xxhash.xxh32_intdigest(p.encode(), n) for n, p in enumerate([" " + word, word[:4], word[:5], word[:6]])]

    def seen(text):
        tokens = text.lower().split()
        raw = text.encode()
        kinds = [0] * 7
        for c in raw:
            kinds[0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if c == 32 else 4 if c == 10 else 5 if c < 128 else 6] += 1
        n = max(len(tokens), 1)
        dense = [k / max(len(raw), 1) for k in kinds] + [len(set(tokens)) / n, sum(a == b for a, b in zip(tokens, tokens[1:])) / n, len(raw) / n / 10, math.log1p(len(tokens)), float(len(tokens) < 5)]
        return [h for t in set(tokens) for h in parts(t)], dense

    by_id = {}
    for i, t in docs:
        by_id.setdefault(i, []).append(seen(t or ""))
    rows = [(q + 1 - t, *f) for i, q, t in labels if q in (0, 1) and t in (0, 1) for f in by_id.get(i, [])]
    often, held = {}, {}
    for g, hs, _ in rows:
        for h in hs:
            often[h] = often.get(h, 0) + 1
            held[h] = held.get(h, 0) + (g == 2)
    base = sum(g == 2 for g, _, _ in rows) / len(rows)
    gain = {h: abs(held[h] - n * base) / math.sqrt(n * base * (1 - base) + 1e-9) for h, n in often.items() if n >= quality.MIN_DOCS}
    used = [h for h in sorted(gain, key=lambda h: (-gain[h], h))[: quality.KEPT] if gain[h] >= quality.ERRORS]
    m, n = quality.MEASURES, len(rows)
    mean = [sum(r[2][k] for r in rows) / n for k in range(m)]
    scale = [math.sqrt(sum((r[2][k] - mean[k]) ** 2 for r in rows) / n) + 1e-6 for k in range(m)]
    scaled = lambda dense: [min(max((v - a) / s, -6), 6) for v, a, s in zip(dense, mean, scale)]
    place = {h: k for k, h in enumerate(sorted(used))}
    data = [(g, [place[h] for h in hs if h in place], scaled(d)) for g, hs, d in rows]
    a, b = len(place), len(place) + m
    start = [math.log(s / (1 - s)) for s in (min(max(sum(g <= k for g, _, _ in data) / n, 1e-3), 1 - 1e-3) for k in (0, 1))]
    p = [0.0] * b + [start[0], math.log(max(start[1] - start[0], 0.05))]
    f, s = [0.0] * len(p), [0.0] * len(p)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for t in range(1, quality.STEPS + 1):
        theta = [p[b], p[b] + math.exp(p[b + 1])]
        grad = [0.0] * a + [1e-4 * v for v in p[a:b]] + [0.0, 0.0]
        for g, at, x in data:
            score = sum(p[k] for k in at) + sum(v * w for v, w in zip(x, p[a:b]))
            cdf = [0.0, sigmoid(theta[0] - score), sigmoid(theta[1] - score), 1.0]
            pdf = [c * (1 - c) for c in cdf]
            prob = max(cdf[g + 1] - cdf[g], 1e-9)
            down = (pdf[g + 1] - pdf[g]) / prob / n
            for k in at:
                grad[k] += down
            for k, v in enumerate(x):
                grad[a + k] += down * v
            for k, sign in ((g, -1), (g - 1, 1)):
                if 0 <= k < 2:
                    each = sign * pdf[k + 1] / prob / n
                    grad[b] += each
                    if k == 1:
                        grad[b + 1] += each * math.exp(p[b + 1])
        for k, v in enumerate(grad):
            f[k], s[k] = 0.9 * f[k] + 0.1 * v, 0.99 * s[k] + 0.01 * v * v
            rate = quality.RATE / (math.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
            p[k] -= rate * f[k] / (1 - 0.9**t)
            if k < a:
                p[k] = math.copysign(max(abs(p[k]) - min(rate * quality.SPARSITY / math.sqrt(n), 0.02), 0), p[k])
    theta = [p[b], p[b] + math.exp(p[b + 1])]
    out = []
    for i, t in docs:
        hs, dense = seen(t or "")
        score = sum(p[place[h]] for h in hs if h in place) + sum(v * w for v, w in zip(scaled(dense), p[a:b]))
        above = [1 - sigmoid(v - score) for v in theta]
        out.append((i, sum(above), above[1]))
    return out


def test_quality_query(spark, tmp_path):
    """op5 and the pipeline's stage against plain loops."""
    d = "/root/testdata/sf0.001"
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(plain_quality(docs, labels))
    got = sorted(tuple(r) for r in queries.op5_quality(spark, d).select("doc_id", "expected_grade", "tail_probability", "keep").collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1:3] for g in got], [w[1:] for w in want], atol=1e-6)
    assert all(g[3] == (g[2] >= quality.LEAST) for g in got)
    kept = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [w[0] for w in want if w[2] >= quality.LEAST]
    clash = spark.read.parquet(f"{d}/documents.parquet").withColumn("__grade", F.lit("x"))
    assert [r["__grade"] for r in quality.graded(clash.limit(3), quality.train(clash, spark.read.parquet(f"{d}/labels.parquet"))).collect()] == ["x"] * 3


def test_quality(spark, edge):
    """Held-out accuracy: fitted on one half of the labels, judged on the other."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.graded(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", (labels.quality * (1 - labels.toxic)).alias("good"), "tail_probability", "expected_grade").collect()
    assert np.mean([r["keep"] == (r["good"] == 1) for r in rows]) > 0.85
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)
    odd = edge.withColumnRenamed("lang", "keep")
    assert quality.graded(odd, model).columns == ["doc_id", "text", "source", "n_chars", *quality.RESULT]
    assert quality.graded(odd, model).count() == edge.count() and quality.graded(edge.limit(0), model).count() == 0
    assert quality.train(docs, labels.limit(0)) is None and quality.graded(edge, None).where("keep").count() == edge.count()
    bad = spark.createDataFrame([(0, None, 1), (None, 1, 1), (1, 7, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, bad) is None


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_nearest(rows, k=5):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        best = {}
        for v in (v for i, v in good if i == q):
            for i, x in good:
                if i != q:
                    best[i] = max(best.get(i, -9), float((x * v).sum() / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum()))))
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k])]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist(), 0) for k in range(300)]
    hot = rng.normal(size=8).tolist()
    rows += [(300 + k, hot, 0) for k in range(120)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1050, [float("nan")] + [1.0] * 7, 0), (1002, [None] + [1.0] * 7, 0), (1003, [float("inf")] * 8, 0), (1004, [1.0], 0), (None, hot, 0), (5, hot, 0), (1006, [1e-30] * 8, 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect())
    want = brute_nearest(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    wide = neighbours.nearest(df.selectExpr("vec_id", "cast(embedding as array<double>) embedding", "label list"), df.where("vec_id % 50 = 0"))
    assert sorted(tuple(r)[:3] for r in wide.collect()) == [w[:3] for w in want]
    few = df.where("vec_id in (0, 1, 2)")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 2
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_repeated_neighbours(spark):
    """Rows that repeat a near vec_id take the place of no other."""
    at = lambda c: [c, (1 - c * c) ** 0.5] + [0.0] * 6
    rows = [(0, at(1.0), 0)] + [(2, at(0.9), 0)] * 5 + [(2, at(0.3), 0), (3, at(0.8), 0), (4, at(0.7), 0), (4, at(0.75), 0), (5, at(0.6), 0), (6, at(0.5), 0), (7, at(0.4), 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id = 0")).collect())
    want = brute_nearest(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] == [(0, r, i) for r, i in enumerate([2, 3, 4, 5, 6], 1)]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)


def test_neighbour_blocks(spark, monkeypatch):
    """Lists dealt in small blocks give the same; recall on real rows."""
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in df.collect()]
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), lists=60).collect()
    x = {i: np.array(v, float) for i, v, _ in rows}
    hit = 0
    for q in {r["query_id"] for r in got}:
        s = sorted(((-float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), i) for i, v in x.items() if i != q))[:5]
        hit += len({i for _, i in s} & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit >= 0.9 * len(got) and len(got) == 50


def test_graph_search():
    rng = np.random.default_rng(3)
    centers = neighbours._unit(rng.normal(size=(500, 16)))
    x = neighbours._unit(rng.normal(size=(100, 16)))
    ids, dist = neighbours.search(x, centers, neighbours.graph(centers), 8)
    best = np.argsort(-(x @ centers.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids.tolist(), best.tolist())]) > 7.2 and (np.diff(dist, axis=1) >= 0).all()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    sizes, columns = [docs.count()], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0 and sizes[1] == sizes[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", ["quality", "lines", "near_duplicates", "decontamination", "packing"])
def test_stage_edges(spark, edge, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, edge, SF)
    assert out.count() >= 1 and stage(spark, edge.limit(0), SF).count() == 0


def stage_rows():
    """The edge rows with n_chars, near copies, a doc_id with two texts, repeated rows, and passages of the benchmark."""
    rng = random.Random(21)
    text = prose(rng, 80)
    rows = [(i, t, lang, str(k), 7) for k, (i, t, lang, *_) in enumerate(edge_rows())]
    return rows + [(40, text, "x", "a", 1), (41, text + " end", "x", "b", 1), (42, prose(rng, 30), "x", "c", 1), (42, text + " too", "x", "d", 1), (43, prose(rng, 40), "x", "e", 1), (43, prose(rng, 40), "x", "f", 1), (44, text, "x", "g", 1), (44, text, "x", "h", 1)]


def test_near_duplicates_stage(spark):
    """Against brute force; a kept doc_id keeps all its texts, repeated rows stay once."""
    rows = stage_rows()
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "kept"), SF)
    assert got.columns == ["doc_id", "text", "kept", "source", "n_chars"]
    kept = {g[0] for g in brute_groups(rows) if g[0] is not None and g[3]}
    want = {(r[0], r[1]) for r in rows if r[0] in kept}
    found = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, [*want, *((r[0], r[1]) for r in rows if r[0] is None)]))
    assert {43, 40} <= kept and 41 not in kept


def test_decontamination_stage(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    passage = max((t for _, t in items), key=len)
    rows = stage_rows() + [(50, passage, "x", "y", 1), (51, passage[: len(passage) // 2] + " and " + prose(random.Random(1), 20), "x", "y", 1), (51, "short", "x", "y", 1), (52, prose(random.Random(2), 900) + " " + passage, "x", "y", 1)]
    got = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "__hit"), SF)
    judged = {(r[0], r[1]): brute_hits([r], items)[0][5] for r in rows}
    assert sorted((str((r["doc_id"], r["text"])) for r in got.collect())) == sorted(str((r[0], r[1])) for r in rows if not judged[r[0], r[1]])
    assert judged[50, passage] and not judged[51, "short"]


def test_packing_stage(spark):
    """All ids of all rows lie in one piece each, in order, in sequences without gaps."""
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = stage_rows()
    want = sorted((str(r[0]), zlib.crc32(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    got = [r.asDict() for r in corpus_pipeline.pack(spark, spark.createDataFrame(rows, DOCS), SF).collect()]
    whole = sorted((str(g["doc_id"]), g["ids_crc32"], g["doc_tokens"]) for g in got if g["length"] == g["doc_tokens"])
    assert set(whole) <= set(want) and sum(g["length"] for g in got) == sum(w[2] for w in want)
    sequences = {}
    for g in got:
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_line_query(spark):
    keyed = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "xxhash64(text) k", "text").collect()
    want = [(d, n, g, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n, g in brute_removed(keyed)]
    assert sorted(tuple(r) for r in queries.op4_line_chunks(spark, SF).collect()) == sorted(want)


def passages(seed, n):
    """n passages of 2 to 8 lines, each in two documents between lines of their own."""
    rng = random.Random(seed)
    own = lambda: [f"own {rng.random()}" for _ in range(rng.randint(1, 4))]
    for k in range(n):
        shared = [f"shared {k} {j}" for j in range(2 + k % 7)]
        yield shared, own() + shared + own(), own() + shared + own()


def test_chunks_find_short_passages():
    """Lines of passages of 2 to 8 lines that stand in a chunk of either document."""
    met = all_ = 0
    for shared, a, b in passages(1, 700):
        cut = [{tuple(t[p : p + n]) for p, n in line_chunks.chunks([x.encode() for x in t]) if n > 1} for t in (a, b)]
        met, all_ = met + sum(map(len, cut[0] & cut[1])), all_ + len(shared)
    assert met >= 0.25 * all_


def test_chunks_leave_no_line_of_a_copy():
    """A text's last line is in a chunk of two lines or more, so a copy goes whole."""
    for n in range(2, 200):
        assert all(m > 1 for _, m in line_chunks.chunks([f"line {n} {k}".encode() for k in range(n)]))


def runs_removed(rows):
    """Without chunks(): from each two places in order the longest equal run, extended line by line."""
    order = sorted((line_chunks.LAST if d is None else d, key, t) for d, key, t in set(rows))
    lines = [(t or "").split("\n") for _, _, t in order]
    at = {}
    for x, part in enumerate(lines):
        for k, line in enumerate(part):
            at.setdefault(line, []).append((x, k))
    gone = [set() for _ in lines]
    for places in at.values():
        for j, (x, k) in enumerate(places):
            for y, m in places[:j]:
                n = 0
                while k + n < len(lines[x]) and m + n < len(lines[y]) and lines[x][k + n] == lines[y][m + n]:
                    n += 1
                gone[x] |= {k + i + e for i in range(n - 1) if "".join(lines[x][k + i : k + i + 2]).encode().strip() for e in (0, 1)}
    cut = {(d, key): ("\n".join(v for k, v in enumerate(part) if k not in g), len(g)) for (d, key, _), part, g in zip(order, lines, gone)}
    out = []
    for d, key, t in rows:
        kept, n = cut[line_chunks.LAST if d is None else d, key]
        out.append((d, None if t is None else kept, 0 if t is None else len(t.split("\n")), n))
    return sorted(out, key=str)


def test_remove_runs(spark):
    rows = [(2 * k + e, "\n".join(t), "", "", 1) for k, (_, *two) in enumerate(passages(2, 40)) for e, t in enumerate(two)]
    rows += [(200, "x\n\n\n\ny\nx\n\n\n\ny", "", "", 1), (201, "z\nz\nz\nz", "", "", 1), (None, rows[0][1], "", "", 1)] + edge_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(4).cache()
    keyed = [tuple(r) for r in df.selectExpr("doc_id", "xxhash64(text) k", "text").collect()]
    got = line_chunks.remove_chunks(df, line_chunks.pairs).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted(map(tuple, got.collect()), key=str) == runs_removed(keyed)


def test_line_stage(spark):
    """Every line of every passage goes from the later document, none of its own."""
    two = [(a, b, len(shared)) for shared, a, b in passages(3, 40)]
    docs = spark.createDataFrame([(2 * k + e, "\n".join(t), "", "", 1) for k, (*ab, _) in enumerate(two) for e, t in enumerate(ab)], DOCS)
    got = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    for k, (a, b, n) in enumerate(two):
        assert got[2 * k] == a and got[2 * k + 1] == [x for x in b if x.startswith("own")]
