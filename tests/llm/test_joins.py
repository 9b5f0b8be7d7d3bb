import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellquarry.llm import cluster, decontamination, embedding_dedup, ngram_join
from cellquarry.llm.hnsw import Graph


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_classes(rows):
    """Links and smallest id of the component, by all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    links, root = [0] * n, [r[0] for r in rows]
    edges = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    for _ in range(n):
        for i, j in edges:
            low = min(root[i], root[j])
            root[i] = root[j] = low
    return Counter((r[0], c, k) for r, c, k in zip(rows, root, links, strict=True))


def test_jaccard_matches_brute_force(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [list(r.choice(words, 120)) for _ in range(12)]
    for k, b in enumerate(base):
        for j in range(int(r.integers(1, 14))):
            own = list(b)
            for _ in range(int(r.integers(0, 5))):
                own[int(r.integers(len(own)))] = str(r.choice(words))
            rows.append((len(rows) * 3 + 1, " ".join(own)))
            if j % 4 == 0:
                rows.append((len(rows) * 3 + 1, " ".join(own)))
    chain = list(r.choice(words, 150))
    for j in range(30):  # a chain whose ends are not alike
        chain[j * 5] = f"x{j}"
        rows.append((len(rows) * 3 + 1, " ".join(chain)))
    rows += [(9001, None), (9002, ""), (9003, "a b"), (9004, "A, b!"), (9005, "!!!"), (9006, "z " * 20000), (rows[0][0], rows[0][1])]
    extra = docs_of(spark, rows).withColumn("class_id", F.lit("clash"))
    for block in (256, 4):
        got = Counter((x["doc"], x["class_id"], x["n_links"]) for x in ngram_join.jaccard_classes(extra, block=block).collect())
        assert got == brute_classes(rows)
    kept = ngram_join.keep_one(extra)
    assert kept.columns == extra.columns
    classes = brute_classes([x for x in rows if re.search(r"\w", x[1] or "")])
    assert kept.where(F.col("text").rlike(r"\w")).count() == len({c for _, c, _ in classes})


def test_jaccard_of_nothing_and_null_ids(spark):
    empty = docs_of(spark, []).withColumn("x", F.lit(1))
    assert ngram_join.jaccard_classes(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0
    rows = [(None, "one two three four five six"), (7, "one two three four five six"), (None, None)]
    got = {(x["doc"], x["class_id"], x["n_links"]) for x in ngram_join.jaccard_classes(docs_of(spark, rows)).collect()}
    assert got == {(None, 7, 1), (7, 7, 1), (None, None, 0)}


def test_prefixes_shorten_until_the_target():
    probes, real = {6: 9990, 5: 9, 0: 1}, {6: 3, 4: 1}
    assert ngram_join.choose_prefix([{}, probes], 6, 0.9995) == (5, 0.9999) and ngram_join.choose_prefix([{}, probes], 6, 0.99)[0] == 6
    assert ngram_join.choose_prefix([real, probes], 6, 0.9) == (4, 0.9999) and ngram_join.choose_prefix([], 6, 0.9) == (6, 1.0)
    assert ngram_join.choose_prefix([{0: 1}], 6, 0.9) == (1, 0.0)


def test_audit_finds_exact_links_and_common_prefixes(monkeypatch):
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    base = [list(r.choice(words, 90)) for _ in range(6)]
    texts = []
    for b in base:
        for k in (0, 1, 2, 3, 6):
            own = list(b)
            for _ in range(k):
                own[int(r.integers(90))] = str(r.choice(words))
            texts.append(" ".join(own))
    texts += ["", "a b", texts[0]]
    sample, sets = ngram_join.sample_sets([texts[0], texts[5], texts[11], "a b"], 5, 6, 6)
    plain = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for t in texts]
    chosen = [plain[0], plain[5], plain[11], plain[-2]]
    for at_once in (1_000_000, 50):
        monkeypatch.setattr(ngram_join, "COUNTED_AT_ONCE", at_once)
        judged = [row for first, *cols in ngram_join._features(5, 0.8, 6, 6, sample)(texts) for row in zip(*cols, strict=True)]
        for own, (_, _, _, label, met) in zip(plain, judged, strict=True):
            links = [q for q, c in enumerate(chosen) if own and own != c and len(own & c) >= 0.8 * len(own | c)]
            values = lambda x: [(int(x) >> ngram_join.VALUE_BITS * (5 - d)) & 1023 for d in range(6)]
            shared = [max(next((i for i, (a, b) in enumerate(zip(values(x), values(y), strict=True)) if a != b), 6) for x, y in zip(label, sample.labels[q].view(np.int64), strict=True)) for q in links]
            assert met == shared
    got = ngram_join.probe_prefixes(sets, sample.labels, 0.8, 6, 6)
    met = lambda p: np.mean(got >= p)
    assert len(got) == 4 * ngram_join.PROBES and abs(met(3) - (1 - (1 - 0.8**3) ** 6)) < 0.12 and met(1) > 0.98


def test_forest_shortens_a_prefix_that_misses(spark):
    # Two trees: whole labels meet for one pair in two at the threshold, so the audit must shorten the prefix.
    r = np.random.default_rng(12)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(60):
        own = list(r.choice(words, 100))
        rows.append((2 * i, " ".join(own)))
        own[50] = own[20] = "changed"
        rows.append((2 * i + 1, " ".join(own)))
    docs = docs_of(spark, rows).withColumnRenamed("doc_id", "doc").withColumn("text_hash", F.xxhash64("text"))
    _, prefix, recall = ngram_join.forest(docs, trees=2, target_recall=0.9)
    assert prefix < ngram_join.DEPTH and recall >= 0.9
    got = Counter((x["doc"], x["class_id"], x["n_links"]) for x in ngram_join.jaccard_classes(docs_of(spark, rows)).collect())
    assert got == brute_classes(rows)


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["component"] for x in cluster.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(k, k) == v for k, v in root.items())


def brute_links(rows, threshold=0.93):
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            unit[i] = (label, a / np.linalg.norm(a))
    links, root = [0] * len(rows), [r[0] for r in rows]
    edges = [(i, j) for i in unit for j in unit if j < i and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= threshold]
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    for _ in range(len(rows)):
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    return Counter((r[0], k, c) for r, k, c in zip(rows, links, root, strict=True))


def test_embeddings_match_brute_force(spark):
    r = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for c in range(8):
            centre = r.normal(size=16)
            for _ in range(int(r.integers(1, 12))):
                rows.append((len(rows), [float(np.float32(x)) for x in centre + r.normal(size=16) * 0.15], label))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(5)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 10, rows[0][1], None), (n + 11, [1.0, 2.0], 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    for shard_bytes in (1 << 20, 9 * 4 * 16):
        out = embedding_dedup.link_classes(df, shard_bytes=shard_bytes).collect()
        assert Counter((x["vec_id"], x["n_links"], x["component_id"]) for x in out) == brute_links(rows)
        assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in out)
    assert embedding_dedup.link_classes(df.limit(0)).count() == 0


def test_graph_recall():
    v = embedding_dedup.units(np.random.default_rng(4).normal(size=(1500, 24)))
    graph = Graph(v)
    truth = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    ids, _ = graph.search(v[:200], 64)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, truth, strict=True)]) >= 0.9


def test_tiling_catches_reordered_passages(spark):
    first = "one two three four five six seven. Eight nine ten eleven twelve thirteen."
    swapped = "Noise here. eight nine ten eleven twelve thirteen and then one two three four five six seven"
    benchmark = spark.createDataFrame([(1, first), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    texts = [swapped, "one two three but little else of it", None, "", "alpha beta gamma delta epsilon zeta eta theta " * 2000, "alpha beta gamma delta x y z eta theta"]
    docs = docs_of(spark, list(enumerate(texts)))
    out = {r["doc_id"]: r for r in decontamination.leaks(docs, benchmark, ["doc_id"]).collect()}
    assert [out[i]["contaminated"] for i in range(6)] == [True, False, False, False, True, False]
    assert out[0]["item_id"] == 1 and out[0]["coverage"] == 1.0 and out[5]["coverage"] == 0.5 and out[2]["item_id"] is None
    kept = decontamination.keep_clean(docs.withColumn("extra", F.lit(1)), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5} and "extra" in kept.columns
    assert decontamination.leaks(docs, benchmark.limit(0), ["doc_id"]).where("contaminated").count() == 0
    assert decontamination.leaks(docs.limit(0), benchmark, ["doc_id"]).count() == 0


def test_short_items_are_found_inside_texts(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "one two three four"), (4, "gamma")], "item_id long, text string")
    texts = ["so alpha beta it is", "alpha or beta", "gamma", "one two three", "x one two three four gamma"]
    out = {r["doc_id"]: (r["coverage"], r["item_id"], r["n_items"]) for r in decontamination.leaks(docs_of(spark, list(enumerate(texts))), benchmark, ["doc_id"]).collect()}
    assert out == {0: (1.0, 1, 1), 1: (0.0, None, 0), 2: (1.0, 2, 2), 3: (0.0, None, 0), 4: (1.0, 2, 3)}


def test_blocks_of_items_agree(spark, monkeypatch):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words, 20))) for i in range(12)]
    docs = docs_of(spark, [(i, f"{' '.join(r.choice(words, 30))} {items[i % 12][1] if i % 3 else ''}") for i in range(40)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(tuple, decontamination.leaks(docs, benchmark, ["doc_id"]).collect()), key=repr)
    whole = rows()
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 50)
    assert rows() == whole and sum(x[-1] for x in whole) >= 26


def greedy_tiles(p, t, least):
    """Tiles by trying every pair of places."""
    fp, ft, out = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and fp[i + k] and ft[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        out.append((i, j, k))
        for d in range(k):
            fp[i + d] = ft[j + d] = False


@pytest.mark.parametrize("seed", range(8))
def test_tiles_match_brute_force(seed):
    r = np.random.default_rng(seed)
    p, t = r.integers(0, 4, 18).astype(np.uint64), r.integers(0, 4, 40).astype(np.uint64)
    seeds = defaultdict(list)
    for i in range(len(p) - 2):
        seeds[tuple(p[i : i + 3])].append(i)
    pairs = [(i, j) for j in range(len(t) - 2) for i in seeds[tuple(t[j : j + 3])]]
    at = np.array(pairs, np.int64).reshape(-1, 2)
    assert decontamination.tiles(p, t, at[:, 0], at[:, 1], 3) == greedy_tiles(list(p), list(t), 3)


def test_audit_widens_beams_where_near_pairs_are_sparse():
    # A graph with few links, whose members have no partners: probes alone are true pairs.
    r = np.random.default_rng(6)
    members = embedding_dedup.units(r.normal(size=(800, 24))).astype(np.float32)
    queries = embedding_dedup.units(r.normal(size=(800, 24))).astype(np.float32)
    paired = r.permutation(800)[:100]
    queries[paired] = embedding_dedup.units(members[paired] + r.normal(size=(100, 24)) * 0.03)
    truth = queries @ members.T >= 0.93
    graph = Graph(members, links=2, beam=4)
    first, *_ = embedding_dedup.candidates(lambda at: graph.search(queries[at], embedding_dedup.BEAM), 800, 800, embedding_dedup.BEAM, 0.93)
    beam, found, real = embedding_dedup.audited_beam(graph, 0.93)
    q, m, crowded = embedding_dedup.candidates(lambda at: graph.search(queries[at], beam), 800, 800, beam, 0.93)
    assert beam > embedding_dedup.BEAM and real >= embedding_dedup.PROBES and found >= 0.99 * real and len(first) < truth.sum()
    assert truth[q, m].all() and (beam == 800 or len(q) >= 0.95 * truth.sum())


def test_sparse_pairs_in_a_large_shard(spark):
    # The graph is far larger than its beams; pairs, a crowd and a chain stand in it, and two shards share them in the second run.
    r = np.random.default_rng(7)
    v = r.normal(size=(2400, 24))
    v[2200:2280] = v[:80] + r.normal(size=(80, 24)) * 0.08
    v[2280:2360] = v[80] + r.normal(size=(80, 24)) * 0.02
    for i in range(2361, 2400):
        v[i] = v[i - 1] + r.normal(size=24) * 0.25
    rows = [(i, [float(np.float32(x)) for x in w], 1) for i, w in enumerate(v[r.permutation(2400)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    e = embedding_dedup.units(np.array([x[1] for x in rows]))
    near = e @ e.T >= 0.93
    np.fill_diagonal(near, False)
    root = np.arange(2400)
    while (new := np.minimum(root, np.where(near, root[None, :], 2400).min(1))).tolist() != root.tolist():
        root = new
    for shard_bytes in (1 << 20, 1200 * 4 * 24):
        out = sorted(map(tuple, embedding_dedup.link_classes(df, shard_bytes=shard_bytes).collect()))
        found = np.array([x[1] for x in out])
        assert found.sum() >= 0.995 * near.sum() and (found <= near.sum(1)).all()
        assert np.mean([x[2] == c for x, c in zip(out, root, strict=True)]) >= 0.995
    reps = df.selectExpr("cast(label as string) label", "24 size", "vec_id rep", "1L weight", "cast(embedding as array<double>) embedding")
    audit = embedding_dedup.audits(embedding_dedup.graphs(reps, shard_bytes=1 << 20)).collect()
    assert len(audit) == 1 and audit[0]["beam"] < 2400 and audit[0]["recall"] >= embedding_dedup.TARGET_RECALL


def test_crowds_are_counted_exactly():
    r = np.random.default_rng(8)
    a, b = (embedding_dedup.units(np.concatenate([r.normal(size=(20, 8)), r.normal(size=8) + r.normal(size=(600, 8)) * 0.1])) for _ in range(2))
    weights = r.integers(1, 5, 1240)
    links = embedding_dedup.Links(np.arange(1240), weights, 0.93)
    rows = np.sort(r.permutation(620)[:500])
    links.crowd(rows, a, b, 620)
    hit = a @ b.T >= 0.93
    hit[np.setdiff1d(np.arange(620), rows)] = False
    assert np.allclose(links.links, np.concatenate([hit @ weights[620:], weights[:620] @ hit]))
