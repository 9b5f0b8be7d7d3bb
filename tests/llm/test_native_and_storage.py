import gzip
import hashlib
import io
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellquarry.llm import cluster, source_mix, url_filter, warc


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path):
    best = None
    for action, text in url_filter.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = (action, text)
    return best


def plain_model(urls):
    """Counts of (context, next) by label, and the smoothed log-likelihood ratio per character."""
    k = url_filter.ORDER
    counts = {a: Counter() for a in (True, False)}
    windows = lambda u: [(("\u0002" * k + (u or "") + "\u0003")[i - k : i], ("\u0002" * k + (u or "") + "\u0003")[i]) for i in range(k, k + len(u or "") + 1)]
    for u, a in urls:
        for context, c in windows(u):
            for n in range(k + 1):
                counts[a][context[k - n :], c] += 1
    total = {a: Counter() for a in counts}
    types = {a: Counter() for a in counts}
    for a in counts:
        for (context, _), n in counts[a].items():
            total[a][context] += n
            types[a][context] += 1

    def probability(a, context, c):
        p = 1 / url_filter.ALPHABET
        for n in range(k + 1):
            own = context[k - n :]
            if total[a][own]:
                p = (counts[a][own, c] + types[a][own] * p) / (total[a][own] + types[a][own])
        return p

    return lambda u: float(np.mean([math.log(probability(True, x, c)) - math.log(probability(False, x, c)) for x, c in windows(u)]))


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=/fr/", "https://a.example.com/en/2", "http://b.net/es/3", "http://b.net/fr/9#x", "http://notexample.com/en/4",
    "http://c.org/de/5", "http://d.net/de/6", "http://x.com", "http://x.com?/en/", "http://netx/es/1", "http://É.com/é\n/x", "http://z.org/" + "y" * 5000,
]


def test_rules_and_ratio_match_plain_python(spark):
    r = np.random.default_rng(1)
    made = [f"http://{r.choice(['a', 'bb', 'www'])}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'fr', 'es', 'de'])}/{i}" for i in range(300)]
    urls = [*URLS, *made, *made[:20]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    out = {x["page_id"]: x for x in url_filter.judge(df).collect()}
    assert len(out) == len(urls)
    labelled = {}
    for i, u in enumerate(urls):
        host, path = plain_host_path(u)
        rule = plain_rule(host, path)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule and rule[1]), u
        assert out[i]["verdict"] == rule[0] if rule else out[i]["verdict"] in ("allow", "block")
        if rule:
            labelled[u] = rule[0] == "allow"
    fold = {x["url"]: x["f"] for x in df.select("url", (F.pmod(F.xxhash64("url", F.lit(31)), F.lit(5)) == 0).alias("f")).collect()}
    ratio = plain_model([(u, a) for u, a in labelled.items() if not fold[u]])
    for i in (0, 2, 9, 10, 20, 50, 80):
        assert out[i]["llr"] == pytest.approx(ratio(urls[i]), abs=1e-9)
    scores = [(ratio(u), a) for u, a in labelled.items() if fold[u]]
    quality = lambda cut: sum((s >= cut) == a for s, a in scores)
    by_rule = [out[i] for i in range(len(urls)) if not out[i]["rule"]]
    cut = max((x["llr"] for x in by_rule if x["verdict"] == "block"), default=-9)
    assert all(x["llr"] > cut for x in by_rule if x["verdict"] == "allow") and quality(cut) >= 0.8 * len(scores)


def test_url_filter_without_labels(spark):
    df = spark.createDataFrame([(1, "http://c.org/x"), (2, None)], "page_id long, url string")
    assert {(x["page_id"], x["verdict"], x["llr"]) for x in url_filter.judge(df).collect()} == {(1, "allow", 0.0), (2, "allow", 0.0)}
    assert url_filter.judge(df.limit(0)).count() == 0


def pages(spark, htmls):
    return spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_url_models_keep_all_contexts(spark):
    r = np.random.default_rng(4)
    urls = ["".join(x) for x in r.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), (4000, 40))]
    rows = spark.createDataFrame([(u, i % 2 == 0) for i, u in enumerate(urls)], "url string, accepted boolean")
    padded = [url_filter.START * url_filter.ORDER + u + url_filter.END for u in urls]
    want = {w[i - k : i] for w in padded for i in range(url_filter.ORDER, len(w)) for k in range(url_filter.ORDER + 1)}
    assert len(want) > 100_000 and url_filter.train(rows).count() == len(want)


def test_url_models_and_threshold_use_every_labelled_url(spark, monkeypatch):
    urls = [f"http://a{i % 37}.com/p{i}" for i in range(27_000)] + [f"http://b.net/es/{i}" for i in range(300)] + ["http://c.org/p1", "http://d.org/es/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    checked, calibrate = {}, url_filter.calibrate
    monkeypatch.setattr(url_filter, "calibrate", lambda scored: checked.update({x["accepted"]: x["count"] for x in scored.groupBy("accepted").count().collect()}) or calibrate(scored))
    out = {x["page_id"]: x for x in url_filter.judge(df).collect()}
    held = {x["page_id"] for x in df.where(F.pmod(F.xxhash64("url", F.lit(31)), F.lit(5)) == 0).select("page_id").collect()}
    assert checked == {True: sum(i in held for i in range(27_000)), False: sum(i in held for i in range(27_000, 27_300))} and checked[True] > 5_000
    ratio = plain_model([(u, i < 27_000) for i, u in enumerate(urls[:27_300]) if i not in held])
    for i in (0, 26_999, 27_000, 27_300, 27_301):
        assert out[i]["llr"] == pytest.approx(ratio(urls[i]), abs=1e-9)
    assert (out[27_300]["verdict"], out[27_301]["verdict"]) == ("allow", "block")


def test_url_scores_do_not_depend_on_broadcasts(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.{('com', 'net', 'org')[i % 3]}/{'es/' * (i % 2)}{i}") for i in range(200)], "page_id long, url string")
    results = lambda: {(x["page_id"], x["verdict"], round(x["llr"], 9)) for x in url_filter.judge(df).collect()}
    broadcast = results()
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", 0)
    assert broadcast == results()


def test_warc_round_trip(spark):
    r = np.random.default_rng(1)
    long = ["".join(r.choice(list("abcé <>"), 4000)) for _ in range(6)]
    htmls = [None, "", "short", "short", *long, *long[:3], long[0], "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "z" * 300000]
    df = pages(spark, htmls)
    path = cluster.new_path(spark, "warc-test")
    archive = warc.write(df, path)
    want = set()
    for i, h in enumerate(htmls):
        data = (h or "").encode()
        same = [j for j, g in enumerate(htmls) if (g or "") == (h or "")]
        head = max(same) if len(data) >= 1000 else i
        want.add((i, len(data), hashlib.sha1(data).hexdigest(), "response" if head == i else "revisit", None if head == i else head))
    for size in (16 << 20, 501, 97):
        back = warc.read(archive, size, payloads=True).collect()
        assert {tuple(x[:5]) for x in back} == want and len(back) == len(htmls)
        assert all(x["payload"] == (htmls[x["page_id"]] or "").encode() for x in back if x["record_type"] == "response")
    file = archive.first()["file"].removeprefix("file://")
    assert gzip.open(file).read().startswith(b"WARC/1.1\r\n")
    assert warc.read(warc.write(df.limit(0), path)).count() == 0


def test_warc_reads_headers_of_any_length():
    url = "http://a/" + np.random.default_rng(9).bytes(1_500_000).hex()
    data = warc.record(1, url, b"one", None, hashlib.sha1(b"one").hexdigest()) + warc.record(2, "http://b", b"two", None, hashlib.sha1(b"two").hexdigest())
    assert [(f["warc-page-id"], f["warc-target-uri"]) for f, _ in warc.records(io.BytesIO(data), 0, len(data))] == [("1", url), ("2", "http://b")]


def test_warc_survives_damage_and_false_magic():
    one = warc.record(1, "http://a", b"<p>\x1f\x8b\x08 not a member", None, hashlib.sha1(b"").hexdigest())
    two = warc.record(2, None, b"two", None, hashlib.sha1(b"two").hexdigest())
    data = one + b"\x1f\x8b\x08garbage" + gzip.compress(b"no record") + one[: len(one) // 2] + two
    for cut in range(1, len(data), 7):
        got = [f["warc-page-id"] for a, b in ((0, cut), (cut, len(data))) for f, _ in warc.records(io.BytesIO(data), a, b)]
        assert got == ["1", "2"], cut


def test_sainte_lague_matches_highest_quotients():
    r = np.random.default_rng(2)
    for _ in range(40):
        votes = np.round(r.random(int(r.integers(1, 9))) * 50, 1)
        seats = int(r.integers(0, 60))
        limit = r.integers(5, 40, len(votes))
        for most in (None, limit):
            want = np.zeros(len(votes), int)
            for _ in range(seats):
                open_ = [i for i in range(len(votes)) if votes[i] > 0 and (most is None or want[i] < most[i])]
                if not open_:
                    break
                want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
            assert list(source_mix.sainte_lague(votes, seats, most)) == list(want)


def test_quotas_serve_sources_then_shards():
    targets = {"a": (1000, 500.0), None: (100, 300.0)}
    shards = [("a", 0, 400), ("a", 1, 600), (None, 0, 100)]
    assert source_mix.quotas(targets, shards, 10) == [(40, 20), (60, 30), (10, 30)]
    assert source_mix.quotas({}, [], 10) == []
    blank = [("s", 3, 5)]
    assert source_mix.quotas({"s": (5, 15.0)}, blank, 16) == [(1, 3)]


def test_readers_are_as_many_as_ranges(spark):
    archive = spark.createDataFrame([(f"f{i}", 100 + i) for i in range(5)], "file string, bytes long")
    assert warc.reader_tasks(5, 500, 16 << 20) == 5 and warc.reader_tasks(0, 0, 16 << 20) == 1
    assert warc.reader_tasks(10**6, 10**6 * (16 << 20), 16 << 20) == 62_500
    assert warc.read(archive, 50).rdd.getNumPartitions() == 14
    assert url_filter.spread(spark.range(20_000)).rdd.getNumPartitions() == 3


def test_targets():
    assert source_mix.share_targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    got = source_mix.share_targets([100, 1, 100], [1, 2, 3])
    assert got[1] == 3 and sum(got) == pytest.approx(201) and got[2] == pytest.approx(3 * got[0])
    assert source_mix.share_targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_mix_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        source = [None, "b", "a", "é", "Z"][int(r.choice(5, p=[0.1, 0.5, 0.2, 0.1, 0.1]))]
        rows.append((i, " ".join(["w"] * int(r.integers(0, 400))), source))
    rows += [(1000, None, "a"), (1001, " \t\n", "a"), (1002, "a b　c", "a"), (1003, "q " * 50000, "b"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    first, again = (source_mix.mix(d, shard_words=5000, shard_rows=40).collect() for d in (df, df.repartition(7)))
    assert Counter(map(tuple, first)) == Counter(map(tuple, again)) and len(first) == len(rows)
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    text = {i: t for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    totals, taken, target = Counter(), Counter(), {}
    for x in first:
        assert x["size"] == size_of(text[x["doc_id"]]) and 0 <= x["taken"] <= 3 * x["size"]
        s = source[x["doc_id"]]
        totals[s] += x["size"]
        taken[s] += x["taken"]
        target[s] = x["target"]
    assert all(x["source_size"] == totals[source[x["doc_id"]]] for x in first)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    want = source_mix.share_targets([totals[s] for s in order], [1, 2, 3, 1, 2])
    for s, t in zip(order, want, strict=True):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 0.01 * t + 64
    assert source_mix.mix(df.limit(0)).count() == 0
    mixed = source_mix.apply_mix(df)
    assert sum(x["mix_taken"] for x in mixed.collect()) == sum(x["taken"] for x in first)


def test_pipeline(spark, tmp_path):
    r = np.random.default_rng(4)
    en = "the thing of that was with and for this have from they which there their would about could other".split()
    fr = "le la les des une dans pour que qui avec être déjà où très même ça après français garçon".split()
    text = lambda words, k=60: " ".join(r.choice(words, k))
    rows = [(i, text(en), "en", "s1") for i in range(40)] + [(100 + i, text(fr), "fr", "s2") for i in range(40)]
    item = text(en, 25)
    rows += [(200, rows[0][1], "en", "s1"), (201, "1 2 3 !!", "en", "s1"), (202, None, None, None), (203, f"{text(en)} {item}", "en", "s1"), (204, text(en) + ' token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" ' + text(en), "en", "s2")]
    spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cluster.stored(stage(spark, docs, str(tmp_path)), name)
        seen.append({x["doc_id"] for x in docs.select("doc_id").collect()})
        if name != "source_mix":
            assert docs.columns == before.columns
    every = {x[0] for x in rows}
    assert seen[0] == every - {201, 202} and seen[1] == seen[0] - {200} and seen[2] == seen[1] - {203} and seen[3] == seen[2]
    assert seen[4] <= seen[3] and docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count()


def test_pipeline_keeps_clashing_and_odd_columns(spark, tmp_path):
    r = np.random.default_rng(6)
    en = "the thing of that was with and for this have from they which there their would about could other".split()
    text = lambda k=60: " ".join(r.choice(en, k))
    big = 2**60 + 1
    rows = [(big + i, text(), "en", "s1") for i in range(30)]
    rows += [(None, text(), "en", "s1"), rows[0], rows[0], (big + 90, text() + ' token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "en", None), (big + 91, None, None, None), (big + 92, "", "en", "s1")]
    df = spark.createDataFrame([(i, t, la, s, None) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    extra = "score lang_pred n_words held_out Coverage item_id n_items contaminated redacted secrets _text _path doc text_hash first copies _row row key id hash size taken a.b".split()
    df = df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in extra}).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cluster.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns[: len(before.columns)] == before.columns and docs.dtypes[: len(before.columns)] == before.dtypes
        got = docs.collect()
        assert all(x[c] == c + ("-" if x["doc_id"] is None else str(x["doc_id"])) and x["m"] == {"k": x["doc_id"]} for x in got for c in extra)
        if name not in ("language_id", "source_mix"):
            assert {x["doc_id"] for x in got} == {x[0] for x in rows[:34]} and len(got) == 32
        assert {x["n_chars"] is None for x in got if x["doc_id"] != big + 90} == {True}


def test_warc_keeps_large_and_null_ids(spark, tmp_path):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "http://a", "x" * 1000), (big + 1, None, "x" * 1000), (None, "http://b", "y"), (None, "http://c", "x" * 1000)], "page_id long, url string, html string")
    got = sorted(((x["page_id"], x["record_type"], x["refers_to"]) for x in warc.read(warc.write(df.coalesce(1), f"file://{tmp_path}/w")).collect()), key=str)
    assert got == sorted([(big, "revisit", big + 1), (big + 1, "response", None), (None, "response", None), (None, "revisit", big + 1)], key=str)
