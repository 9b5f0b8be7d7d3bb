"""Language identification of words with a linear-chain conditional random field.

Every word with a letter is a position of the chain.  Its features are the word
itself, its membership in each language's lexicon (the commonest words of the
training texts), affixes of 1 to 4 characters and character 2- and 3-grams, all
hashed.  Emission weights and transitions are learned together by maximising
the conditional likelihood, with forward-backward giving the expectations, on
segments of which half are spliced from documents of different languages, so
that the chain learns how often code-switched text changes its language.

Prediction runs forward-backward over whole texts.  A text is cut into chunks
only for vectorisation: each chunk's transfer matrix carries the exact messages
across, so the marginals are those of one chain over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import annotate, restored
from .textkit import U64, Words, letters, mix, word_batches

HASH_BITS = 18
#: Labelled documents per language in the training sample (the documented bound).
TRAIN_PER_LANGUAGE = 150
LEXICON = 400
SEGMENT = 32
EPOCHS = 3
CHUNK = 64
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (2 ** HASH_BITS, languages)
    transitions: np.ndarray  # (languages, languages), log potentials
    lexicon: np.ndarray  # sorted hashes of lexicon words
    members: np.ndarray  # (lexicon words, languages) booleans


def with_letter(words: Words) -> np.ndarray:
    """Indexes of the words that hold a letter."""
    seen = np.concatenate([[0], np.cumsum(letters()[np.minimum(words.codes, 0x10FFFF)])])
    return np.flatnonzero(seen[words.end] > seen[words.start])


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + U64(kind * 0x1F123BB5)) >> U64(64 - HASH_BITS)).astype(np.int64)


def word_features(words: Words, at: np.ndarray, lexicon: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) pairs of the words at the given indexes."""
    start, end = words.start[at], words.end[at]
    length, who = end - start, np.arange(len(at))
    whole = words.span_hash(start, end)
    owners, slots = [who], [_slot(whole, 1)]
    for k in (1, 2, 3, 4):
        fits = np.flatnonzero(length >= k)
        owners += [fits, fits]
        slots += [_slot(words.span_hash(start[fits], start[fits] + k), 10 + k), _slot(words.span_hash(end[fits] - k, end[fits]), 20 + k)]
    for n in (2, 3):
        count = np.maximum(length - n + 1, 0)
        owner = np.repeat(who, count)
        begin = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        owners.append(owner)
        slots.append(_slot(words.span_hash(begin, begin + n), 30 + n))
    if len(lexicon):
        place = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[place] == whole)
        row, language = np.nonzero(members[place[known]])
        owners.append(known[row])
        slots.append(_slot(language.astype(np.uint64), 40))
    return np.concatenate(owners), np.concatenate(slots)


def emissions(words: Words, at: np.ndarray, model: Model) -> np.ndarray:
    """Log potentials of each word, computed once for each distinct word."""
    _, first, back = np.unique(words.span_hash(words.start[at], words.end[at]), return_index=True, return_inverse=True)
    owner, slot = word_features(words, at[first], model.lexicon, model.members)
    table = np.stack([np.bincount(owner, model.weights[slot, k], len(first)) for k in range(len(model.languages))], 1)
    return table[back]


def _messages(psi: np.ndarray, real: np.ndarray, move: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages inside chunks, given those at their ends."""
    n, width, k = psi.shape
    forward, backward = np.empty((n, width, k)), np.empty((n, width, k))
    a, b = head, tail
    for t in range(width):
        new = (a @ move) * psi[:, t]
        a = np.where(real[:, t, None], new / new.sum(1, keepdims=True), a)
        forward[:, t] = a
    for t in range(width - 1, -1, -1):
        backward[:, t] = b
        new = (psi[:, t] * b) @ move.T
        b = np.where(real[:, t, None], new / new.sum(1, keepdims=True), b)
    return forward, backward


def marginals(scores: np.ndarray, offset: np.ndarray, transitions: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Posterior of each word's language; ``offset`` cuts the words into texts."""
    n, k = scores.shape
    lengths = np.diff(offset)
    chunks = -(-lengths // chunk)
    begin = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    if not total:
        return np.zeros((0, k))
    text = np.repeat(np.arange(len(lengths)), chunks)
    step = np.arange(total) - begin[text]
    where = (offset[:-1][text] + step * chunk)[:, None] + np.arange(chunk)
    real = where < offset[1:][text][:, None]
    where = np.minimum(where, n - 1)
    psi = np.exp(scores - scores.max(1, keepdims=True))[where] + 1e-300
    move = np.exp(transitions - transitions.max())
    carry = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(chunk):
        new = (carry @ move) * psi[:, t, None, :]
        new /= new.max((1, 2), keepdims=True)
        carry = np.where(real[:, t, None, None], new, carry)
    head, tail = np.full((total, k), 1 / k), np.full((total, k), 1 / k)
    for s in range(1, int(chunks.max())):
        at = np.flatnonzero(step == s) if s < 4 else (begin + s)[chunks > s]
        out = np.einsum("ni,nij->nj", head[at - 1], carry[at - 1])
        head[at] = out / out.sum(1, keepdims=True)
    for s in range(int(chunks.max()) - 2, -1, -1):
        at = (begin + s)[chunks > s + 1]
        out = np.einsum("nij,nj->ni", carry[at + 1], tail[at + 1])
        tail[at] = out / out.sum(1, keepdims=True)
    forward, backward = _messages(psi, real, move, head, tail)
    both = forward * backward
    return (both / both.sum(2, keepdims=True))[real]


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Learns the field from (text, language) pairs; segments are spliced half of the time."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    rng = np.random.default_rng(seed)
    parts: list[tuple[Words, np.ndarray, np.ndarray]] = []
    for words in word_batches([t for t, _ in rows]):
        at = with_letter(words)
        owner = words.text_of_word()[at]
        label = np.array([languages.index(rows[words.first + i][1]) for i in range(words.n_texts)])
        parts.append((words, at, label[owner]))
    hashes = np.concatenate([w.span_hash(w.start[at], w.end[at]) for w, at, _ in parts])
    labels = np.concatenate([label for *_, label in parts])
    vocabulary, back = np.unique(hashes, return_inverse=True)
    counts = np.stack([np.bincount(back[labels == c], minlength=len(vocabulary)) for c in range(k)], 1)
    common = np.zeros((len(vocabulary), k), bool)
    for c in range(k):
        top = np.argsort(-counts[:, c], kind="stable")[:LEXICON]
        common[top, c] = counts[top, c] > 1
    chosen = np.flatnonzero(common.any(1))
    lexicon, members = vocabulary[chosen], common[chosen]
    owners, slots = [], []
    seen = np.zeros(len(vocabulary), bool)
    for words, at, _ in parts:
        which = np.searchsorted(vocabulary, words.span_hash(words.start[at], words.end[at]))
        _, first = np.unique(which, return_index=True)
        first = first[~seen[which[first]]]
        seen[which[first]] = True
        owner, slot = word_features(words, at[first], lexicon, members)
        owners.append(which[first][owner])
        slots.append(slot)
    owner, slot = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owner, kind="stable")
    slot, begin = slot[order], np.searchsorted(owner[order], np.arange(len(vocabulary) + 1))
    weights, squares = np.zeros((1 << HASH_BITS, k), np.float32), np.full((1 << HASH_BITS, k), 1e-2, np.float32)
    trans, trans_sq = np.zeros((k, k)), np.full((k, k), 1e-2)
    by_language = [np.flatnonzero(labels == c) for c in range(k)]
    n_segments = max(1, len(labels) // SEGMENT)
    for _ in range(EPOCHS):
        for _ in range(max(1, n_segments // 256)):
            x = np.empty((256, SEGMENT), np.int64)
            for row in x:
                cuts = sorted(rng.choice(np.arange(1, SEGMENT), rng.integers(1, 4), replace=False)) if rng.random() < 0.5 else []
                for a, b in zip([0, *cuts], [*cuts, SEGMENT], strict=True):
                    own = by_language[rng.integers(k)]
                    s = rng.integers(max(1, len(own) - (b - a)))
                    row[a:b] = np.resize(own[s : s + b - a], b - a)
            word, gold = back[x], labels[x]
            used, inverse = np.unique(word, return_inverse=True)
            count = begin[used + 1] - begin[used]
            mine = np.repeat(np.arange(len(used)), count)
            feats = slot[begin[used][mine] + np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count)]
            table = np.stack([np.bincount(mine, weights[feats, c], len(used)) for c in range(k)], 1)
            score = table[inverse.reshape(word.shape)]
            psi = np.exp(score - score.max(2, keepdims=True)) + 1e-300
            move = np.exp(trans)
            flat = np.full((len(x), k), 1 / k)
            fw, bw = _messages(psi, np.ones(x.shape, bool), move, flat, flat)
            post = fw * bw
            post /= post.sum(2, keepdims=True)
            pair = fw[:, :-1, :, None] * move * (psi * bw)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            diff = post - np.eye(k)[gold]
            per_word = np.stack([np.bincount(inverse.ravel(), diff[:, :, c].ravel(), len(used)) for c in range(k)], 1) / len(x)
            touched, to = np.unique(feats, return_inverse=True)
            grad = np.stack([np.bincount(to, per_word[mine, c], len(touched)) for c in range(k)], 1) + 1e-5 * weights[touched]
            squares[touched] += grad**2
            weights[touched] -= 0.1 * grad / np.sqrt(squares[touched])
            seen_pairs = np.bincount((gold[:, :-1] * k + gold[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
            grad = (pair.sum((0, 1)) - seen_pairs) / len(x)
            trans_sq += grad**2
            trans -= 0.1 * grad / np.sqrt(trans_sq)
    return Model(languages, weights, trans, lexicon, members)


def label_texts(texts: list[str | None], model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sub-batches: index of the first text, words with a letter and summed posteriors of each."""
    k = len(model.languages)
    for words in word_batches(texts):
        at = with_letter(words)
        offset = np.searchsorted(at, words.offset)
        mass = np.zeros((words.n_texts, k))
        if len(at) and k:
            post = marginals(emissions(words, at, model), offset, model.transitions)
            owner = np.repeat(np.arange(words.n_texts), np.diff(offset))
            for c in range(k):
                mass[:, c] = np.bincount(owner, post[:, c], words.n_texts)
        yield words.first, np.diff(offset), mass


def word_languages(text: str, model: Model) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word with a letter of one text."""
    out = []
    for words in word_batches([text]):
        at = with_letter(words)
        if len(at):
            post = marginals(emissions(words, at, model), np.array([0, len(at)]), model.transitions)
            folded = text.lower()
            out += [(folded[words.start[i] : words.end[i]], model.languages[p.argmax()], float(p.max())) for i, p in zip(at, post, strict=True)]
    return out


def training_rows(docs: DataFrame, allowed, per_language: int = TRAIN_PER_LANGUAGE) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts, the same for the same rows.

    ``allowed`` is a Column; ids are drawn by hash for each language from
    narrow columns first, and only the drawn texts are fetched.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    ids = docs.where(allowed & F.col("lang").isNotNull()).select("doc_id", "lang")
    ids = ids.withColumn("row", F.row_number().over(order)).where(F.col("row") <= per_language).select("doc_id").distinct()
    drawn = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    drawn = drawn.withColumn("row", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "text"))).where(F.col("row") <= per_language)
    return [(r.text, r.lang) for r in drawn.orderBy("doc_id", "text", "lang").collect()]


def predict(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """`carried` columns of ``docs`` and ``lang_pred``, ``score``, ``n_words``; reads ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[str | None]) -> Iterator[tuple]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for first, n, mass in label_texts(texts, model):
            known = (n > 0) & (len(model.languages) > 0)
            best = np.where(known, mass.argmax(1) if mass.shape[1] else 0, len(model.languages))
            score = np.where(known, mass.max(1, initial=0) / np.maximum(n, 1), 0.0)
            yield first, names[best], np.clip(score, 0, 1), n

    return annotate(docs, columns, [F.col("text").cast("string")], "lang_pred string, score double, n_words long", judge)


def identify(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Trains on documents whose crc32(doc_id) mod 3 is not 1 and predicts all.

    A null or letterless text is ``und`` with score 0; so is every text where no
    labelled row exists to learn from.  Very long texts are labelled whole, in
    chunks whose messages are passed on exactly.  Rows with a null id are never
    trained on and not held out; repeated rows are predicted alike, an empty
    table gives an empty result.  A result replaces a column of its name.
    """
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    rows = training_rows(docs, remainder != 1)
    model = train(rows) if rows else Model([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros((0, 0), bool))
    columns = [*columns, "held_out"]
    found = predict(docs.withColumn("held_out", F.coalesce(remainder == 1, F.lit(False))), model, columns)
    return restored(found, columns, ("lang_pred", "score", "n_words"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, ["doc_id"]).select("doc_id", "held_out", "lang_pred", "score", "n_words")


#: A document goes if no language holds at least this share of its words.
LEAST_SHARE = 0.4


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those that have no letter or no prevailing language.

    Null and empty texts go, as they have no letter; very long texts are judged
    whole.  Where no labelled row exists to learn from, nothing can be rejected
    and all rows stay.  Repeated rows stay or go together; other columns pass
    through, whatever their names.
    """
    names = docs.columns
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    rows = training_rows(docs, remainder != 1)
    if not rows:
        return docs
    kept = predict(docs, train(rows), names)
    return restored(kept.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SHARE)), names)
