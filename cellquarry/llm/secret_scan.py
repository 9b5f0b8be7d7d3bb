"""Secret scanning: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of token characters and values assigned by ``=`` or
``:``.  A forest of decision trees, trained in numpy on labelled findings,
judges each by its length and characters, its character transitions, how much
of it dictionary words cover, the path it comes from and the words beside it.
`example_findings` makes labelled findings by rule, of published token formats
and of look-alikes; findings labelled elsewhere can be given in their place.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import annotate, restored

RUN = re.compile(r"[A-Za-z0-9+/_~.=-]{16,}")
ASSIGNED = re.compile(r"[=:]\s{0,4}[\"'`]?([^\s\"'`<>,;(){}\[\]]{8,})")
#: Where the value of a parameter inside an assigned value begins; a name may also begin the value after a colon.
PARAMETER = re.compile(r"[?&][A-Za-z_][\w.-]*=")
NAMED = re.compile(r"[A-Za-z_][\w.-]*=(?=[^=&]{8})")
WORDS = (
    "about account action address admin agent alert amount apache array attach author backup batch binary block board branch browser "
    "buffer build button bytes cache camera cancel center change channel charge client cloud cluster column command comment commit config "
    "connect console contact content context control copy count create credit current custom data database default delete demo deploy "
    "detail device digest direct display document domain download driver dummy email enable engine error event example export factory "
    "field file filter folder form format frame function gateway general global graph group handler hash header height history home host "
    "icon image import index info input install instance interface internal item java json kernel label language layer layout length level "
    "library license light limit line link list local location login logo manager map master match media member memory menu message method "
    "model module monitor name native network node note number object option order output package page panel parse part path payment phone "
    "place player plugin point policy pool port post price print process product profile project property protocol provider public query "
    "queue random range read record region release remote report request reset resource response result role root route rule sample save "
    "scale schema scope screen script search section select send series server service session setting shape share signal simple site "
    "size source space stage start state static status storage store stream string style submit summary support switch sync system table "
    "target task team template test text theme thread time title toggle total track transfer tree type unit update upload user util value "
    "vector version video view volume web width window work world write your here this that with from not for and the key token secret"
).split()
CUES = frozenset("secret token password passwd pwd apikey api key credential credentials auth bearer private access client signing webhook".split())
DECOYS = frozenset("sha sha1 sha256 md5 checksum digest hash commit revision etag uuid guid id example sample placeholder dummy version build integrity page url http https file path".split())
#: Trees, depth and features tried at each split of the forest.
TREES, DEPTH, TRIED = 40, 9, 7
RESULTS = ("n_candidates", "n_secrets", "secrets", "redacted")


def _assigned(text: str) -> set[tuple[int, int]]:
    """Spans of assigned values; one that holds parameters (a URL, ``a=...&b=...``) is parted at them."""
    out = set()
    for m in ASSIGNED.finditer(text):
        a, end = m.span(1)
        if m[0][0] == ":" and (named := NAMED.match(text, a, end)):
            a = named.end()
        for cut in PARAMETER.finditer(text, a, end):
            out.add((a, cut.start()))
            a = cut.end()
        out.add((a, end))
    return out


def candidates(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the candidates of a text, none inside another.

    A run ends before an assigned value that begins inside it (``KEY=value``).
    """
    if not text:
        return []
    spans = {s for s in _assigned(text) if s[1] - s[0] >= 8}
    starts = sorted(a for a, _ in spans)
    for m in RUN.finditer(text) if len(text) >= 16 else ():
        a, b = m.span()
        i = bisect_right(starts, a)
        if i < len(starts) and starts[i] < b and text[starts[i] - 1] in "=:":
            b = starts[i]
            while b > a and text[b - 1] == "=":
                b -= 1
        if b - a >= 16:
            spans.add((a, b))
    trimmed = set()
    for a, b in spans:
        while b > a and text[b - 1] in ".,:!?|":
            b -= 1
        while a < b and text[a] in "=./-~":
            a += 1
        if b - a >= 8:
            trimmed.add((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(trimmed, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _log_bigrams() -> dict[str, float]:
    counts: dict[str, int] = {}
    for w in WORDS:
        for a, b in zip(f"^{w}", f"{w}$", strict=True):
            counts[a + b] = counts.get(a + b, 0) + 1
    total = sum(counts.values())
    return {k: math.log((v + 0.1) / total) for k, v in counts.items()}


@lru_cache(maxsize=1)
def _dictionary() -> re.Pattern:
    return re.compile("|".join(sorted((w for w in WORDS if len(w) > 3), key=len, reverse=True)))


def _kinds(s: str) -> str:
    return "".join("d" if "0" <= c <= "9" else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "s" for c in s)


def features(text: str, start: int, end: int, path: str | None) -> list[float]:
    """The numbers that the forest sees of a candidate."""
    s = text[start:end]
    n, low = len(s), s.lower()
    kinds = _kinds(s)
    share = lambda k: kinds.count(k) / n
    entropy = -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))
    table, floor = _log_bigrams(), math.log(0.01 / 3000)
    flow = sum(table.get(a + b, floor) for a, b in zip(f"^{low}", f"{low}$", strict=True)) / (n + 1)
    covered = sum(len(m) for m in _dictionary().findall(low)) / n
    switches = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    letters = [len(m) for m in re.findall(r"[a-z]+", low)]
    vowels = sum(c in "aeiou" for c in low) / max(1, sum(letters))
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    words = re.findall(r"[a-z0-9]+", before.lower())[-4:]
    near = {*words, *(w[:-1] for w in words if w.endswith("s"))}
    glued = re.sub(r"[^a-z]", "", before.lower())[-14:]
    where = (path or "").lower()
    return [
        n, entropy, share("d"), share("u"), share("l"), share("s"), flow, covered, switches, max(letters, default=0), vowels,
        float(all(c in string.hexdigits for c in s)), float(n in (32, 40, 64)), s.count("-"), s.count("."), s.count("/"),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", before))), float(before[-1:] in "\"'`" and after[:1] in "\"'`" and before != ""),
        float(bool(near & CUES)) + float(any(glued.endswith(c) for c in ("key", "token", "secret", "password"))), float(bool(near & DECOYS)),
        float(bool(words) and words[-1] in CUES), len(set(s)) / n, float("@" in before[-1:] + after[:1]),
        float(bool(re.search(r"test|example|sample|fixture|doc", where))), float(bool(re.search(r"\.(env|ini|ya?ml|json|toml|cfg|conf|pem)$|config|secret", where))),
    ]


@dataclass
class Forest:
    """Trees as arrays: split feature (-1: leaf), threshold, left child (right is next) and share of secrets."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    share: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, share in zip(self.feature, self.threshold, self.left, self.share, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, left[at] + right, at)
            total += share[at]
        return total / len(self.feature)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    feature, threshold, left, share = [-1], [0.0], [0], [float(y.mean())]
    open_ = [(0, np.arange(len(y)), 0)]
    while open_:
        node, rows, depth = open_.pop()
        own = y[rows]
        if depth == DEPTH or len(rows) < 4 or own.min() == own.max():
            continue
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], TRIED, replace=False):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            v, z = v[order], own[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                ones, n = np.cumsum(z)[cut], cut + 1.0
                rest, m = z.sum() - ones, len(z) - n
                impurity = ones * (1 - ones / n) + rest * (1 - rest / m)
                i = int(impurity.argmin())
                if impurity[i] < best[0]:
                    best = (impurity[i], int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[1] < 0:
            continue
        feature[node], threshold[node], left[node] = best[1], best[2], len(feature)
        above = x[rows, best[1]] > best[2]
        for part in (rows[~above], rows[above]):
            feature.append(-1)
            threshold.append(0.0)
            left.append(0)
            share.append(float(y[part].mean()) if len(part) else share[node])
            open_.append((len(feature) - 1, part, depth + 1))
    return np.array(feature), np.array(threshold), np.array(left), np.array(share)


def train_forest(findings: list[tuple[str, int, int, str | None, int]], seed: int = 5, trees: int = TREES) -> Forest:
    """Trains on (text, start, end, path, 1 if a secret)."""
    rng = np.random.default_rng(seed)
    x = np.array([features(*f[:4]) for f in findings])
    y = np.array([f[4] for f in findings], np.float64)
    grown = []
    for _ in range(trees):
        rows = rng.integers(len(y), size=len(y))
        grown.append(_grow(x[rows], y[rows], rng))
    return Forest(*map(list, zip(*grown, strict=True)))


def example_findings(n: int = 4000, seed: int = 3) -> list[tuple[str, int, int, str | None, int]]:
    """Labelled findings made by rule: half secrets in published formats, half look-alikes."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum, base = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = "an en er on th re tion ing ou ai eau ment ung lich keit der que os as do ra mi ber ver sch ti sh ha in".split()
    made = lambda k: "".join(r.choice(syllables) for _ in range(k))
    prose = lambda k: " ".join(r.choice([made(r.randint(1, 4)), r.choice(WORDS)]) for _ in range(k))
    uuid = lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
    out = []
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            value = r.choice([
                lambda: pick(hexa, r.choice([32, 40, 40, 64])), lambda: pick(alnum, r.randint(20, 48)), lambda: pick(base, r.choice([40, 44, 64])), lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 16),
                lambda: r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "sk-", "xoxb-", "npm_"]) + pick(alnum, 36), lambda: pick(alnum + "!#$%&*?-_", r.randint(10, 18)), lambda: f"eyJ{pick(alnum, 17)}.eyJ{pick(alnum, 40)}.{pick(alnum, 43)}",
            ])()
            cue = r.choice(["token", "api_key", "apiKey", "secret", "password", "client_secret", "AUTH_TOKEN", "private_key", "access_key", "SECRET_KEY", "passwd", "auth"])
            strong = value.startswith(("AKIA", "gh", "glpat", "sk", "xoxb", "npm_", "eyJ"))
            lead = r.choice([f'{cue} = "', f"{cue}='", f"{cue}: ", f"{cue}=", f'"{cue}": "', f"export {cue.upper()}="]) if not strong or r.random() < 0.7 else r.choice(["", "Bearer ", '"'])
            path = r.choice([None, None, "src1", "src0", "app/config.yaml", ".env", "settings.py", "tests/test_api.py"])
        else:
            kind = r.choice([0, 0, *range(12)])
            value = [
                lambda: r.choice([str, str, str.upper, str.title])(made(r.randint(5, 12))), lambda: pick(hexa, r.choice([32, 40, 64])), uuid, lambda: ".".join(r.choice(WORDS) for _ in range(r.randint(3, 6))), lambda: "_".join(r.choice(WORDS) for _ in range(r.randint(3, 5))),
                lambda: "".join(r.choice(WORDS).title() for _ in range(r.randint(3, 6))), lambda: "/".join(r.choice(WORDS) for _ in range(r.randint(3, 6))) + r.choice([".html", ".py", "/", ""]), lambda: pick(string.digits, r.choice([16, 16, 17, 20])),
                lambda: r.choice(["YOUR_API_KEY_HERE", "your-token-goes-here", "xxxxxxxxxxxxxxxxxxxx", "changeme_changeme", "REPLACE_WITH_SECRET", "example_password", "00000000000000000000", "<insert-token-here>"]),
                lambda: r.choice("=-_.~") * r.randint(16, 60), lambda: f"{made(3)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: f"//www.{made(3)}.example.com/{r.choice(WORDS)}/{r.randint(1, 999)}",
            ][kind]()
            plain = r.choice(["", "", '"', ": ", "id=", "page: ", "name = ", "https:", "file=", "version: ", made(2) + ": "])
            lead = {1: r.choice(["commit ", "sha256: ", "md5=", "checksum: ", 'integrity="', "etag: ", "digest = ", "revision "]), 2: r.choice(["uuid: ", "id=", "request ", "guid = "]), 8: r.choice(["token = ", "api_key=", "password: "])}.get(kind, plain)
            path = r.choice([None, None, "src1", "src3", "docs/index.md", "src/main.py", "README.md", "tests/data.json"])
        before = f"{prose(r.randint(0, 5))} {lead}"
        text = f"{before}{value}{lead[-1] if lead[-1:] in list(chr(34) + chr(39)) else ''} {prose(r.randint(0, 4))}"
        out.append((text, len(before), len(before) + len(value), path, int(secret)))
    return out


def find(text: str | None, path: str | None, forest: Forest) -> list[tuple[int, int, float]]:
    """(start, end, score) of each candidate of one text."""
    spans = candidates(text)
    if not spans:
        return []
    scores = forest.score(np.array([features(text, a, b, path) for a, b in spans]))
    return [(a, b, float(p)) for (a, b), p in zip(spans, scores, strict=True)]


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + mark + text[b:]
    return text


#: Candidates scored at once in a task.
SCORED_AT_ONCE = 20_000


def _scan(texts: list[str | None], paths: list[str | None], forest: Forest) -> Iterator[tuple[int, list[list[tuple[int, int, float]]]]]:
    """Candidates with scores, for slices of the texts of bounded candidate numbers."""
    first, rows, spans = 0, [], []

    def done() -> list[list[tuple[int, int, float]]]:
        scores = iter(forest.score(np.array(rows)) if rows else ())
        return [[(a, b, float(next(scores))) for a, b in own] for own in spans]

    for i, (text, path) in enumerate(zip(texts, paths, strict=True)):
        own = candidates(text)
        spans.append(own)
        rows += [features(text, a, b, path) for a, b in own]
        if len(rows) >= SCORED_AT_ONCE:
            yield first, done()
            first, rows, spans = i + 1, [], []
    if spans:
        yield first, done()


def scan(docs: DataFrame, columns: list[str], forest: Forest | None = None, path_col: str | None = "source", least: float = 0.5) -> DataFrame:
    """``columns`` of ``docs``, ``n_candidates``, ``n_secrets``, ``secrets`` and ``redacted``.

    ``secrets`` holds (start, end, score) in characters of the text; ``redacted``
    is the text with each secret replaced, null if there is none.  Null and
    empty texts have no candidates, very long ones are searched whole; a null
    path is like an unknown one.  Repeated rows are judged alike, an empty table
    gives an empty result; a result replaces a column of its name.
    """
    return restored(_scanned(docs, columns, forest, path_col, least), columns, RESULTS)


def _scanned(docs: DataFrame, columns: list[str], forest: Forest | None = None, path_col: str | None = "source", least: float = 0.5) -> DataFrame:
    """`scan` with `carried` columns."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or train_forest(example_findings()))
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")

    def judge(texts: list[str | None], paths: list[str | None]) -> Iterator[tuple]:
        for first, found in _scan(texts, paths, shared.value):
            secrets = [[s for s in own if s[2] >= least] for own in found]
            redacted = [redact(texts[first + i], [s[:2] for s in own]) if own else None for i, own in enumerate(secrets)]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in own] for own in secrets]
            yield first, [len(own) for own in found], [len(own) for own in secrets], spans, redacted

    kinds = "n_candidates long, n_secrets long, secrets array<struct<start: long, end: long, score: double>>, redacted string"
    return annotate(docs, columns, [F.col("text").cast("string"), path], kinds, judge)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's candidates and secrets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, ["doc_id"]).select("doc_id", "n_candidates", "n_secrets", "secrets")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All of ``docs``, secrets replaced in the text (and ``n_chars`` counted again).

    Null, empty and repeated rows stay as they are unless a secret is found;
    other columns pass through, whatever their names.
    """
    names = docs.columns
    found = _scanned(docs, names, path_col="source" if "source" in names else None)
    text, length = f"_p{names.index('text')}", f"_p{names.index('n_chars')}" if "n_chars" in names else None
    if length:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn(length, F.when(F.col("redacted").isNotNull(), F.length("redacted").cast(kind)).otherwise(F.col(length)))
    return restored(found.withColumn(text, F.coalesce("redacted", text)), names)
