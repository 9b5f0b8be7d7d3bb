import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellquarry.llm import language_id, masked_lm, secret_scan, textkit, toxicity

EN = "the thing of that was with and for this have from they which there their would about could other"
FR = "le la les des une dans pour que qui avec être déjà où très même ça après français garçon"
ODD = [None, "", " \n", "12 34 !!", "é" * 3000, "the " * 30000]


def sentences(words, n, seed, k=30):
    r = np.random.default_rng(seed)
    return [" ".join(r.choice(words.split(), k)) for _ in range(n)]


def table(spark, texts, start=0, lang=None, source="s"):
    rows = [(start + i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_words_match_plain_splitting():
    import re

    texts = ["Hello, WORLD ça_va 12x", None, "", "…—", "ß\n\tÀ b", "x" * 50]
    got = []
    for w in textkit.word_batches(texts, at_once=10):
        joined = "\n".join((t or "").lower() for t in texts[w.first : w.first + w.n_texts]) + "\n"
        got += [[joined[a:b] for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.offset[:-1], w.offset[1:], strict=True)]
    assert got == [re.findall(r"\w+", (t or "").lower()) for t in texts]
    hashes = {}
    for w in textkit.word_batches(["a b a", "b a"]):
        for h, word in zip(w.hashes(), ["a", "b", "a", "b", "a"], strict=True):
            assert hashes.setdefault(word, h) == h


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    score, move = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    # The first word's prior is that of a move from any language.
    start = np.exp(move).sum(0)
    want = np.zeros((5, 3))
    total = 0.0
    for path in product(range(3), repeat=5):
        w = start[path[0]] * np.exp(sum(score[t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, s in enumerate(path):
            want[t, s] += w
    for chunk in (2, 64):
        assert np.allclose(language_id.marginals(score, np.array([0, 5]), move, chunk), want / total)


def test_language_of_words_and_documents(spark):
    docs = table(spark, sentences(EN, 60, 1), 0, "en").union(table(spark, sentences(FR, 60, 2), 1000, "fr")).union(table(spark, ODD, 2000, None))
    rows = {r["doc_id"]: r for r in language_id.identify(docs.withColumn("score", F.lit("clash")), ["doc_id"]).collect()}
    assert len(rows) == 126 and all(r["lang_pred"] == ("en" if i < 1000 else "fr") for i, r in rows.items() if i < 2000)
    assert [rows[2000 + i]["lang_pred"] for i in range(4)] == ["und"] * 4 and rows[2005]["lang_pred"] == "en" and 0 <= rows[2005]["score"] <= 1
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    model = language_id.train([(t, "en") for t in sentences(EN, 40, 3)] + [(t, "fr") for t in sentences(FR, 40, 4)])
    mixed = language_id.word_languages("the thing of that was with les des une dans pour que", model)
    assert [x[1] for x in mixed] == ["en"] * 6 + ["fr"] * 6
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 122  # only the four without a letter go
    empty = docs.limit(0)
    assert language_id.identify(empty, ["doc_id"]).count() == 0 and language_id.keep_identified(empty).count() == 0
    unlabelled = table(spark, ["some text"], 5, None)
    assert language_id.identify(unlabelled, ["doc_id"]).first()["lang_pred"] == "und"


def test_toxicity_held_out_accuracy(spark):
    r = np.random.default_rng(5)
    texts = sentences(EN, 400, 6)
    toxic = r.random(400) < 0.3
    texts = [t.replace("which", "zlorgish", 1) + " zlorger" if x else t for t, x in zip(texts, toxic, strict=True)]
    rows = [(t, int(x)) for t, x in zip(texts, toxic, strict=True)]
    model = toxicity.train(rows[:200])
    got = np.concatenate([s for _, s in toxicity.score_texts([t for t, _ in rows[200:]], model)])
    assert ((got >= 0.5) == toxic[200:]).mean() > 0.98
    docs = table(spark, [*texts, *ODD])
    out = {x["doc_id"]: x for x in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert len(out) == 406 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in out.values())
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)], "doc_id long, toxic int")
    drawn = toxicity.training_rows(docs, labels, 50)
    allowed = {t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5}
    assert 0 < len(drawn) <= 100 and {t for t, _ in drawn} <= allowed
    assert toxicity.score(docs, None, ["doc_id"]).agg(F.max("score")).first()[0] < 0.01
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity_draws_from_every_id_and_learns_1500_of_a_label(spark):
    allowed = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:6]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(allowed)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(allowed[0], f"again {k}") for k in range(40)] + [(i, f"text {i}") for i in allowed], "doc_id long, text string")
    drawn = toxicity.training_rows(docs, labels, 3)
    assert len(drawn) == 12 and {f"text {i}" for i in allowed[1:]} <= {t for t, _ in drawn}
    many = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert len(toxicity.training_rows(many.select("doc_id", F.col("doc_id").cast("string").alias("text")), many)) == 3000


def test_secrets_held_out_accuracy_and_redaction(spark):
    forest = secret_scan.train_forest(secret_scan.example_findings(1500))
    test = secret_scan.example_findings(400, seed=77)
    score = forest.score(np.array([secret_scan.features(*f[:4]) for f in test]))
    assert ((score >= 0.5) == np.array([f[4] for f in test])).mean() > 0.97
    token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    texts = [f'Some prose token = "{token}" more prose.', f"commit {token} fixed it", "supercalifragilisticexpialidocious words", *ODD]
    docs = table(spark, texts)
    out = {r["doc_id"]: r for r in secret_scan.scan(docs, ["doc_id"], forest).collect()}
    assert out[0]["n_secrets"] == 1 and texts[0][out[0]["secrets"][0]["start"] : out[0]["secrets"][0]["end"]] == token
    assert all(out[i]["n_secrets"] == 0 for i in range(1, 9))
    clean = secret_scan.redact_secrets(docs)
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == docs.columns and rows[0]["text"] == 'Some prose token = "[secret]" more prose.' and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[1]["text"] == texts[1] and rows[3]["text"] is None
    assert secret_scan.scan(docs.limit(0), ["doc_id"], forest).count() == 0


def test_unquoted_assignments_give_their_values():
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    values = lambda t: [t[a:b] for a, b in secret_scan.candidates(t)]
    for text in (f"API_KEY={key}", f"env: API_KEY={key}", f"A=short&token={key}&page=12", f"see https://x.example.com/p?id=3&token={key}"):
        assert key in values(text) and not any(key in v and v != key for v in values(text)), text
    assert values("password=hunter2abcdef9") == ["hunter2abcdef9"] and values("QWxhZGRpbjpvcGVuIHNlc2FtZQ==") == ["QWxhZGRpbjpvcGVuIHNlc2FtZQ=="]
    assert values(f"AWS_SECRET_ACCESS_KEY={key}") == ["AWS_SECRET_ACCESS_KEY", key]
    forest = secret_scan.train_forest(secret_scan.example_findings(1500))
    assert all(p >= 0.5 for *_, p in secret_scan.find(f"API_KEY={key}", None, forest))


def plain_log_likelihood(texts, flat, vocabulary, counts):
    """Sums over each text's words of the logs of group, leaf and word in the leaf, by plain loops over all outputs."""
    w, out = masked_lm.split(flat.astype(np.float64)), []
    mass = np.zeros(masked_lm.CLASSES)
    leaf_of = {}
    for words in textkit.word_batches(texts, at_once=1):
        leaves, _, hashes, _ = masked_lm.classes(words, vocabulary)
        leaf_of.update(zip(hashes.tolist(), leaves.tolist(), strict=True))
    for h, n in counts.items():
        mass[leaf_of[h]] += n
    for words in textkit.word_batches(texts, at_once=1):
        h = words.hashes().tolist()
        total = 0.0
        for i, own in enumerate(h):
            hidden = w["bias"].copy()
            for k, o in enumerate(masked_lm.OFFSETS):
                inside = 0 <= i + o < len(h)
                hidden += w["embed"][k][leaf_of[h[i + o]] if inside else masked_lm.BEYOND]
            hidden = np.tanh(hidden)
            group, leaf = divmod(leaf_of[own], masked_lm.LEAVES)
            for scores, at in ((hidden @ w["group"] + w["group_bias"], group), (hidden @ w["leaf"][group] + w["leaf_bias"][group], leaf)):
                total += scores[at] - np.log(np.exp(scores).sum())
            total += np.log(counts[own] / mass[leaf_of[own]])
        out.append(total)
    return out


def test_masked_lm_matches_plain_probabilities(spark):
    many = " ".join(f"w{i}" for i in range(masked_lm.TOP + 100))  # so that some words that occur again are in leaves of endings
    texts = [*sentences(EN, 25, 8), *sentences(FR, 4, 9), f"{many} {many} {many}", "once only zzz qqxyz qqxyz", ""]
    docs = table(spark, texts)
    counts = masked_lm.count_words(docs)
    vocabulary = masked_lm.vocabulary_of(counts, masked_lm.TOP)
    flat = masked_lm.train(docs.select("text"), vocabulary)
    seen = {}
    for words in textkit.word_batches(texts):
        for h in words.hashes().tolist():
            seen[h] = seen.get(h, 0) + 1
    want = plain_log_likelihood(texts, flat, vocabulary, seen)
    got = {r["doc_id"]: r for r in masked_lm.pseudo_likelihood(docs, ["doc_id"], masked_lm.TOP).collect()}
    assert np.allclose([got[i]["log_likelihood"] for i in range(len(texts))], want, rtol=1e-5, atol=1e-3)
    assert got[30]["n_once"] == 3 and got[31]["n_once"] == 0


def test_masked_lm_does_not_depend_on_tasks(spark):
    docs = table(spark, sentences(EN, 300, 11, 12) + sentences(FR, 300, 12, 12))
    few, many = ({r["doc_id"]: r["per_word"] for r in masked_lm.pseudo_likelihood(docs.repartition(n), ["doc_id"]).collect()} for n in (2, 16))
    assert max(abs(few[i] - many[i]) for i in few) < 1e-3
    vocabulary = masked_lm.top_only(masked_lm.vocabulary_of(masked_lm.count_words(docs)))
    flat = masked_lm.start(docs.select("text"), vocabulary).flat
    (one, n), (other, m) = (masked_lm.gradient(docs.select("text").repartition(k), flat, vocabulary) for k in (1, 13))
    assert n == m == 7200 and np.allclose(one, other, atol=1e-2) and np.abs(one).max() > 1


def test_masked_lm_learns_from_all_documents(spark):
    docs = table(spark, sentences(EN, 400, 11, 12) + sentences(FR, 400, 12, 12))  # beyond 600, the former sample
    vocabulary = masked_lm.top_only(masked_lm.vocabulary_of(masked_lm.count_words(docs)))
    got = masked_lm.start(docs.select("text").repartition(3), vocabulary).flat
    texts = {}
    for row in docs.select("text", F.pmod(F.xxhash64("text", F.lit(37)), F.lit(masked_lm.BLOCKS)).alias("block")).collect():
        texts.setdefault(row["block"], []).append(row["text"])
    flat, m, v, step, seen = masked_lm.fresh_weights().astype(np.float64), 0, 0, 0, 0
    leaves = [c for own in texts.values() for words in textkit.word_batches(own) for c in masked_lm.classes(words, vocabulary)[0]]
    n = np.bincount(leaves, minlength=masked_lm.CLASSES).reshape(masked_lm.GROUPS, masked_lm.LEAVES) + 1
    w = masked_lm.split(flat)
    w["group_bias"][:], w["leaf_bias"][:] = np.log(n.sum(1) / n.sum()), np.log(n / n.sum(1)[:, None])
    for block in sorted(texts):
        grad, size = np.zeros(masked_lm.SIZE), 0
        for words in textkit.word_batches(texts[block]):
            y = masked_lm.classes(words, vocabulary)[0]
            masked_lm.walk(flat, masked_lm.windows(y, words.offset), y, grad)
            size += len(y)
        step, seen = step + 1, seen + size
        m, v = 0.9 * m + 0.1 * grad / size, 0.99 * v + 0.01 * (grad / size) ** 2
        flat -= masked_lm.BLOCK_RATE * (1 - block / masked_lm.BLOCKS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    assert seen == 9600 and len(texts) == masked_lm.BLOCKS
    assert np.allclose(got, flat, atol=1e-3) and np.abs(got - masked_lm.fresh_weights()).max() > 0.1


def test_masked_lm_start_is_no_sample(spark):
    # The former start took these 600 texts, so it gave the same network with and without the others.
    docs = table(spark, sentences(EN, 400, 11, 12) + sentences(FR, 400, 12, 12))
    vocabulary = masked_lm.top_only(masked_lm.vocabulary_of(masked_lm.count_words(docs)))
    sample = docs.orderBy(F.xxhash64(F.xxhash64("text"), F.lit(37))).limit(600)
    whole, part = (masked_lm.start(x.select("text"), vocabulary).flat for x in (docs, sample))
    assert np.abs(whole - part).max() > 1e-2


def test_masked_lm_odd_rows(spark):
    texts = ["a b c d e f g h " * 20] * 30 + sentences(EN, 30, 8)
    docs = table(spark, [*texts, *ODD, "h c a f b e g d " * 20]).withColumns({"n_words": F.lit(1), "Base": F.lit("x"), "row": F.lit(2), "others": F.lit("y")})
    found = masked_lm.pseudo_likelihood(docs, ["doc_id", "Base", "row", "others"])
    out = {r["doc_id"]: r for r in found.collect()}
    assert found.columns == ["doc_id", "Base", "row", "others", "per_word", "log_likelihood", "n_once", "n_words"]
    assert len(out) == 67 and out[0]["n_words"] == 160 and out[0]["per_word"] > out[66]["per_word"] and np.isclose(out[0]["per_word"], out[1]["per_word"], atol=1e-6)
    assert all(out[60 + i]["n_words"] == 0 and out[60 + i]["log_likelihood"] == 0 and out[60 + i]["per_word"] is None for i in (0, 1, 2))
    assert out[65]["n_words"] == 30000 and out[0]["Base"] == "x" and out[0]["row"] == 2 and out[0]["others"] == "y"
    assert masked_lm.pseudo_likelihood(docs.limit(0), ["doc_id"]).count() == 0
    assert masked_lm.pseudo_likelihood(docs.where("text is null"), ["doc_id"]).first()["per_word"] is None


def test_masked_lm_walk_holds_few_scores_at_once():
    # A block of windows at a time, so that scores stay in the cache; all scores of these windows are 67 MB.
    rng, n = np.random.default_rng(5), 131_072
    y = (masked_lm.CLASSES * rng.random(n) ** 3).astype(np.int16)  # some leaves are common
    x = masked_lm.windows(y, np.arange(0, n + 1, 256))
    flat, grad = masked_lm.fresh_weights(), np.zeros(masked_lm.SIZE)
    tracemalloc.start()
    logs = masked_lm.walk(flat, x, y, grad)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and np.isfinite(logs).all() and np.abs(grad).max() > 1


def test_masked_lm_windows_stay_inside_their_texts():
    cls, offset = np.arange(12, dtype=np.int16), np.array([0, 0, 1, 3, 3, 12, 12])
    want = [[cls[i + o] if a <= i + o < b else masked_lm.BEYOND for o in masked_lm.OFFSETS] for a, b in zip(offset, offset[1:], strict=False) for i in range(a, b)]
    assert np.array_equal(masked_lm.windows(cls, offset), want)
    assert masked_lm.windows(cls[:0], offset[:2]).shape == (0, len(masked_lm.OFFSETS)) and len(masked_lm.windows(cls[:1], np.array([0, 1]))) == 1


def test_masked_lm_walk_takes_large_scores():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, masked_lm.CLASSES + 1, (300, len(masked_lm.OFFSETS))), rng.integers(0, masked_lm.CLASSES, 300)
    flat = masked_lm.fresh_weights() * 200
    got, want = np.zeros(masked_lm.SIZE), np.zeros(masked_lm.SIZE)
    logs = masked_lm.walk(flat, x, y, got)
    plain = masked_lm.walk(flat.astype(np.float64), x, y, want)
    assert logs.min() < -100 and np.allclose(logs, plain, rtol=1e-4, atol=1e-2) and np.isfinite(got).all() and np.allclose(got, want, rtol=1e-2, atol=5e-2 * np.abs(want).max())


def test_masked_lm_tells_repeated_documents_apart(spark):
    # Words are made of many syllables, so every document has some that no other has, unless it is there twice.
    r = np.random.default_rng(13)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    texts = [" ".join("".join(r.choice(syllables, int(r.integers(1, 5)))) for _ in range(60)) for _ in range(200)]
    docs = table(spark, texts).union(table(spark, texts[:20], 1000))
    out = {x["doc_id"]: x["n_once"] for x in masked_lm.pseudo_likelihood(docs, ["doc_id"]).collect()}
    assert all(out[i] == out[1000 + i] == 0 for i in range(20)) and min(out[i] for i in range(20, 200)) > 0


def test_masked_lm_scores_every_word_by_its_own_count(spark):
    # Enough commoner words to fill the vocabulary; two rarer words of one ending differ by their counts alone.
    fill = " ".join(f"w{i}" for i in range(masked_lm.VOCABULARY + 100))
    docs = table(spark, [fill, fill, fill, fill, "qqxyz", "qqxyz", "zzxyz", None])
    out = {r["doc_id"]: r["log_likelihood"] for r in masked_lm.pseudo_likelihood(docs, ["doc_id"]).collect()}
    assert len(out) == 8 and out[7] == 0 and np.isclose(out[4], out[5], atol=1e-5) and np.isclose(out[4] - out[6], np.log(2), atol=1e-5)


def test_masked_lm_vocabulary_size_changes_no_score(spark):
    # More words than TOP, so that many are outside the smallest vocabulary and counted differently.
    r = np.random.default_rng(10)
    names = [f"{a}{b}{c}xyz" for a in "bcdfghjklm" for b in "aeiouvwpqr" for c in range(40)]
    texts = [" ".join(np.array(names)[np.minimum(r.geometric(0.0008, 400) - 1, 3999)]) for _ in range(60)]
    docs = table(spark, [*texts, texts[0]])
    small, whole = ({x["doc_id"]: x for x in masked_lm.pseudo_likelihood(docs, ["doc_id"], size).collect()} for size in (masked_lm.TOP, masked_lm.VOCABULARY))
    v = masked_lm.vocabulary_of(masked_lm.count_words(docs), masked_lm.TOP)
    known = [np.isin(w.hashes(), v.word).all() for w in textkit.word_batches(texts, at_once=1)]
    assert not all(known) and np.isclose(small[0]["per_word"], small[60]["per_word"], atol=1e-6)
    assert all(np.isclose(small[i]["log_likelihood"], whole[i]["log_likelihood"], rtol=1e-6) and small[i]["n_once"] == whole[i]["n_once"] for i in range(61))


def test_masked_lm_tree_is_normalised_and_its_gradient_right():
    rng = np.random.default_rng(2)
    flat = masked_lm.fresh_weights().astype(np.float64)
    x, y = rng.integers(0, masked_lm.CLASSES + 1, (40, len(masked_lm.OFFSETS))), rng.integers(0, masked_lm.CLASSES, 40)
    every = masked_lm.walk(flat, np.repeat(x[:1], masked_lm.CLASSES, 0), np.arange(masked_lm.CLASSES))
    assert np.isclose(np.exp(every).sum(), 1)
    grad = np.zeros(masked_lm.SIZE)
    masked_lm.walk(flat, x, y, grad)
    for at in rng.choice(np.flatnonzero(np.abs(grad) > 1e-3), 40):
        up, down = flat.copy(), flat.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        assert grad[at] == pytest.approx((masked_lm.walk(down, x, y).sum() - masked_lm.walk(up, x, y).sum()) / 2e-4, rel=1e-3)
    trainer = masked_lm.Trainer(flat)
    before = -masked_lm.walk(trainer.flat, x, y).mean()
    for _ in range(30):
        trainer.learn(x, y)
    assert -masked_lm.walk(trainer.flat, x, y).mean() < before * 0.9


def test_toxicity_matches_plain_features_and_scores():
    # Features, log-count ratios and scores by plain strings and loops, for the weights that training gives.
    import math
    from collections import Counter

    texts = [*sentences(EN, 12, 21, 9), "zlorger " * 3 + "the of", "zlorger", "", None]
    rows = [(t, int("zlor" in (t or ""))) for t in texts]
    model = toxicity.train(rows)

    def plain(text):
        """Slots of each distinct word's distinct features, as often as words have them."""
        out = Counter()
        for words in textkit.word_batches([text], at_once=1):
            lowered = (text or "").lower()
            spans = {lowered[a:b]: (a, b) for a, b in zip(words.start, words.end, strict=True)}
            for word, (a, b) in spans.items():
                span = lambda i, j: words.span_hash(np.array([a + i]), np.array([a + j]))  # noqa: E731, B023
                slots = [toxicity._slot(span(0, len(word)), 3, 0)]
                for n in toxicity.ORDERS:
                    slots += [toxicity._slot(span(*at), kind, n) for kind, at in ((1, (0, n - 1)), (2, (len(word) - n + 1, len(word)))) if len(word) >= n - 1]
                    slots += [toxicity._slot(span(i, i + n), 0, n) for i in range(len(word) - n + 1)]
                out.update(int(s[0]) for s in slots)
            return out, len(spans)

    got = np.concatenate([s for _, s in toxicity.score_texts(texts, model)])
    for text, score in zip(texts, got, strict=True):
        slots, n = plain(text)
        z = sum(model.weights[s] * k for s, k in slots.items()) / math.sqrt(max(1, n)) + model.bias
        assert score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)
    counts = [Counter(), Counter()]
    for text, label in rows:
        counts[label].update(plain(text)[0])
    used = sorted(set(counts[0]) | set(counts[1]))
    totals = [sum(counts[c][s] + 1 for s in used) for c in (0, 1)]
    ratio = {s: math.log((counts[1][s] + 1) / totals[1]) - math.log((counts[0][s] + 1) / totals[0]) for s in used}
    assert all(model.weights[s] == 0 for s in range(0, 1 << toxicity.HASH_BITS, 997) if s not in ratio)
    sure = sorted(used, key=lambda s: -abs(ratio[s]))[:20]  # a coefficient is not negative where a feature tells the labels apart
    assert all(model.weights[s] * ratio[s] >= 0 for s in sure) and max(abs(model.weights[s]) for s in used) > 0


def test_toxicity_keeps_clashing_columns_and_repeated_rows(spark):
    model = toxicity.train([(t, 0) for t in sentences(EN, 20, 22)] + [(t + " zlorger", 1) for t in sentences(EN, 20, 23)])
    docs = table(spark, [*sentences(EN, 3, 24), "zlorger zlorger"]).withColumns({"Score": F.lit("x"), "bias": F.lit(1)})
    found = toxicity.score(docs.union(docs), model, ["doc_id", "bias", "Score"])
    assert found.columns == ["doc_id", "bias", "score", "predicted"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 8 and len(set(rows)) == 4 and {r[3] for r in rows if r[0] == 3} == {1}


def test_forest_matches_plain_trees():
    # Splits by trying every feature and threshold; scores by walking each tree.
    findings = secret_scan.example_findings(120, seed=9)
    x = np.array([secret_scan.features(*f[:4]) for f in findings])
    forest = secret_scan.train_forest(findings, trees=5)

    def walked(row):
        total = 0.0
        for feature, threshold, left, share in zip(forest.feature, forest.threshold, forest.left, forest.share, strict=True):
            at = 0
            while feature[at] >= 0:
                at = left[at] + int(row[feature[at]] > threshold[at])
            total += share[at]
        return total / 5

    assert np.allclose(forest.score(x), [walked(r) for r in x])
    y = np.array([f[4] for f in findings], np.float64)
    feature, threshold, left, share = secret_scan._grow(x, y, np.random.default_rng(0))
    impurity = lambda z: len(z) * z.mean() * (1 - z.mean()) if len(z) else 0.0
    tried = np.random.default_rng(0).choice(x.shape[1], secret_scan.TRIED, replace=False)
    best = min(impurity(y[x[:, f] <= t]) + impurity(y[x[:, f] > t]) for f in tried for t in x[:, f] if (x[:, f] > t).any())
    own = x[:, feature[0]] > threshold[0]
    assert impurity(y[own]) + impurity(y[~own]) == pytest.approx(best) and share[0] == y.mean()
    assert share[left[0]] == y[~own].mean() and share[left[0] + 1] == y[own].mean()


def test_secret_scan_keeps_clashing_columns_and_repeated_rows(spark):
    forest = secret_scan.train_forest(secret_scan.example_findings(600))
    token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    docs = table(spark, [f'token = "{token}"', "plain words", "x" * 200_000 + f' secret = "{token}"']).withColumns({"Secrets": F.lit("x"), "start": F.lit(1)})
    found = secret_scan.scan(docs.union(docs), ["doc_id", "start", "Secrets"], forest)
    rows = found.select("doc_id", "start", "n_secrets").collect()
    assert found.columns == ["doc_id", "start", *secret_scan.RESULTS] and len(rows) == 6 and all(r["start"] == 1 for r in rows)
    assert {(r["doc_id"], r["n_secrets"]) for r in rows} == {(0, 1), (1, 0), (2, 1)}
