"""Operator 2: secret scans with a random forest against false positives.

Patterns propose candidates: known token formats, quoted or assigned values, key
blocks, long unbroken runs of letters and digits. A random forest in numpy reads
each candidate's length, character transitions, dictionary coverage, path and
neighbouring words and scores how likely it is a secret. It is trained on
labelled findings; where none are given, on findings composed from known formats
(secrets) and from look-alikes: digests in their usual settings, identifiers,
placeholders, encoded data, and words of the corpus.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import read, words

# The dictionary: the commonest words of MIN_LETTERS letters or more, counted over all documents.
DICTIONARY_WORDS, MIN_LETTERS = 20_000, 4
TREES, DEPTH, MIN_LEAF = 40, 10, 3
COMPOSED = 3000
# Labelled findings fitted on at most, those of smallest hash.
MAX_TRAIN = 20_000
NEAR = 60

# Formats of common credentials.
FORMATS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "gitlab": r"\bglpat-[A-Za-z0-9_\-]{20,}",
    "slack": r"\bxox[abprs]-[A-Za-z0-9\-]{10,}",
    "google": r"\bAIza[0-9A-Za-z_\-]{35}",
    "stripe": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "jwt": r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]++(?:\.[A-Za-z0-9_\-]++)++",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]|-(?!----))*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?",
    "url_password": r"(?<=://)[^\s/:@]{1,64}:[^\s/@]{3,}(?=@)",
    "assigned": r"(?:(?<=[:=])|(?<=[:=]\s))[\"']?[A-Za-z0-9+/_\-.=!@#$%^&*]{8,}[\"']?",
    "run": r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20,}={0,2}(?![A-Za-z0-9+/_\-])",
}
PATTERNS = {k: re.compile(v) for k, v in FORMATS.items()}
# The head of a token in a part of a dotted run (the pattern "jwt"), and the fewest characters of its other parts.
TOKEN_HEAD = re.compile(r"\beyJ[A-Za-z0-9_\-]{8}")
TOKEN_PART = 8
# Formats of no known issuer, and the fewest characters of each.
GENERIC = {"assigned": 8, "run": 20}
GOOD_WORDS = ["key", "apikey", "secret", "token", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "private", "access", "api", "client", "login"]
BAD_WORDS = ["example", "sample", "test", "dummy", "placeholder", "sha1", "sha256", "sha", "md5", "hash", "checksum", "digest", "commit", "revision", "uuid", "guid", "id", "integrity", "etag", "version", "changeme", "your", "xxx", "fake", "image", "data", "base64"]
PATH_WORDS = ["test", "tests", "example", "examples", "sample", "fixture", "fixtures", "doc", "docs", "mock", "lock", "env", "config", "conf", "settings", "secrets", "prod"]
WORD = re.compile(r"[A-Za-z0-9]+")
LETTERS = re.compile(r"[A-Za-z]+")


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end - start > 1 and text[start] in "\"'":
        start += 1
    while end - start > 1 and text[end - 1] in "\"'.,;!#$%&*":
        end -= 1
    return start, end


def _proposed(text: str, start: int, end: int) -> bool:
    """Whether an assigned value or run is a candidate: short bare words of letters only where a credential's name comes before."""
    if end - start < 8 or not text[start:end].isalpha() or end - start >= 20 or text[start - 1 : start] in ("'", '"'):
        return end - start >= 8
    before = WORD.findall(text[max(0, start - NEAR) : start].lower())
    return bool(before) and any(w in before[-1] for w in GOOD_WORDS)


def _tokens(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The three-part tokens of a dotted run: a head in one part, two long parts behind it. Each part is looked at once."""
    parts = text[start:end].split(".")
    ends = list(accumulate((len(p) + 1 for p in parts), initial=start))[1:]
    i = 0
    while i + 2 < len(parts):
        last = ends[i] - 1
        head = TOKEN_HEAD.search(text, last - len(parts[i]), last) if min(map(len, parts[i + 1 : i + 3])) >= TOKEN_PART else None
        if head:
            yield head.start(), ends[i + 2] - 1
        i += 3 if head else 1


def _known(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what has the format of a known issuer."""
    for kind, pattern in PATTERNS.items():
        if kind in GENERIC:
            continue
        for m in pattern.finditer(text):
            for start, end in _tokens(text, *m.span()) if kind == "jwt" else [m.span()]:
                yield start, end, kind


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each candidate, without the quotes around it.

    Each format is searched on its own. Where formats overlap, known ones come
    before assigned values and these before runs, and of the known ones the
    first and longest; what a run or value has left beside them is looked at alone.
    """
    text = text or ""
    known = sorted(((*_trimmed(text, start, end), kind) for start, end, kind in _known(text)), key=lambda c: (c[0], -c[1]))
    out: list[tuple[int, int, str]] = []
    for c in known:
        if not out or c[0] >= out[-1][1]:
            out.append(c)
    for kind, least in GENERIC.items():
        taken, at, more = sorted(out), 0, []
        for m in PATTERNS[kind].finditer(text):
            start, end = m.span()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            k = at
            while start < end:
                stop = min(end, taken[k][0]) if k < len(taken) else end
                if stop - start >= least:
                    piece = _trimmed(text, start, stop)
                    if _proposed(text, *piece):
                        more.append((*piece, kind))
                start = max(stop, taken[k][1]) if k < len(taken) else end
                k += 1
        out += more
    return sorted(out)


def coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of the letters that dictionary words cover, longest word first from the left."""
    covered = total = 0
    for m in LETTERS.finditer(value.lower()):
        run, at = m.group(), 0
        total += len(run)
        while at < len(run):
            size = next((n for n in range(min(16, len(run) - at), MIN_LETTERS - 1, -1) if run[at : at + n] in dictionary), 0)
            covered += size
            at += size or 1
    return covered / total if total else 0.0


def describe(text: str, start: int, end: int, kind: str, path: str, dictionary: frozenset[str]) -> list[float]:
    """The forest's view of one candidate."""
    value = text[start:end]
    classes = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in value]
    n = len(classes)
    pairs = [a + b for a, b in zip(classes, classes[1:])]
    counts = np.unique(list(value), return_counts=True)[1] / n
    before = WORD.findall(text[max(0, start - NEAR) : start].lower())
    after = WORD.findall(text[end : end + NEAR].lower())
    near = set(before[-6:] + after[:3])
    where = set(WORD.findall((path or "").lower()))
    head = text[max(0, start - 3) : start]
    return [
        math.log1p(end - start), float(-(counts * np.log2(counts)).sum()), len(counts) / n,
        *[classes.count(c) / n for c in "uldo"],
        sum(a != b for a, b in zip(classes, classes[1:])) / n,
        *[pairs.count(p) / n for p in ("ld", "dl", "lu", "ul", "ll", "dd", "do", "od")],
        float(all(c in string.hexdigits for c in value)), float(value.count("-")) / n,
        coverage(value, dictionary),
        float(len(near & set(GOOD_WORDS))), float(len(near & set(BAD_WORDS))),
        float(bool(before) and before[-1] in GOOD_WORDS), float(bool(before) and before[-1] in BAD_WORDS),
        float("=" in head or ":" in head), float(head[-1:] in ("'", '"')),
        float(len(where & set(PATH_WORDS[:11]))), float(len(where & set(PATH_WORDS[11:]))),
        float(list(FORMATS).index(kind)), float(kind not in ("assigned", "run")),
    ]


class Forest:
    """Random forest of gini trees, each held in flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            pick = rng.integers(len(y), size=len(y))
            self.trees.append(self._grow(x[pick], y[pick], rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            mean = float(y[rows].mean())
            for a, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (value, mean)):
                a.append(v)
            if depth == DEPTH or len(rows) < 2 * MIN_LEAF or mean in (0.0, 1.0):
                return me
            best = None
            for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                k = np.arange(MIN_LEAF, len(rows) - MIN_LEAF + 1)
                k = k[v[k - 1] < v[np.minimum(k, len(v) - 1)]]
                if not len(k):
                    continue
                p, q = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(rows) - k)
                impurity = k * p * (1 - p) + (len(rows) - k) * q * (1 - q)
                i = int(impurity.argmin())
                if best is None or impurity[i] < best[0]:
                    best = (impurity[i], f, (v[k[i] - 1] + v[k[i]]) / 2)
            if best is None:
                return me
            go = x[rows, best[1]] <= best[2]
            feature[me], cut[me] = int(best[1]), float(best[2])
            left[me] = node(rows[go], depth + 1)
            right[me] = node(rows[~go], depth + 1)
            return me

        node(np.arange(len(y)), 0)
        return tuple(map(np.array, (feature, cut, left, right, value)))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += value[at]
        return total / len(self.trees)


def composed_findings(dictionary: list[str], n: int = COMPOSED, seed: int = 8) -> pd.DataFrame:
    """(text, start, finish, kind, path, secret): labelled findings of known formats and of look-alikes, half and half."""
    rng = np.random.default_rng(seed)
    vocabulary = dictionary or ["some", "word", "here", "text"]
    pick = lambda x: x[int(rng.integers(len(x)))]
    chars = lambda alphabet, size: "".join(rng.choice(list(alphabet), size))
    hex_digits, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    size = lambda a, b: int(rng.integers(a, b))
    prose = lambda k: " ".join(pick(vocabulary) for _ in range(k))
    rows = []
    while len(rows) < n:
        secret = len(rows) % 2 == 0
        if secret:
            name, path = pick(["api_key", "apiKey", "secret", "token", "auth_token", "access_key", "client_secret", "password", "SECRET_KEY", "TOKEN"]), pick(["src/app", "config", "deploy env", "web", "notes", "src3"])
            value = pick([
                lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + chars(mixed, 36), lambda: "xoxb-" + chars(string.digits, 11) + "-" + chars(mixed, 24),
                lambda: "sk_live_" + chars(mixed, 24), lambda: chars(hex_digits, pick([32, 40, 64])), lambda: chars(hex_digits.upper(), pick([32, 40])), lambda: chars(mixed, size(20, 48)),
                lambda: chars(mixed + "+/", pick([24, 44, 88])) + "=", lambda: chars(mixed + "!@#%", size(10, 20)), lambda: "AIza" + chars(mixed, 35), lambda: "eyJ" + chars(mixed, 30) + "." + chars(mixed, 40) + "." + chars(mixed, 43),
                lambda: chars(string.ascii_letters, size(12, 40)), lambda: chars(string.ascii_lowercase, size(12, 30)),
            ])()
            lead = pick([f'{name} = "', f"{name}: ", f"{name}='", f"{name}=", f"export {name}=", "Authorization: Bearer "])
        else:
            path = pick(["tests/data", "docs", "examples", "package lock", "src/app", "notes", "src5"])
            name = pick(["sha1", "sha256", "md5", "checksum", "commit", "revision", "hash", "digest", "etag", "uuid", "id", "integrity"])
            lead, value = pick([
                lambda: (f'{name}: "', chars(hex_digits, pick([32, 40, 64]))), lambda: (f"{name} ", chars(hex_digits, pick([32, 40, 64]))), lambda: (f"{name}=", "-".join(chars(hex_digits, k) for k in (8, 4, 4, 4, 12))),
                lambda: (pick(['api_key = "', "token: ", "password="]), pick(["xxxxxxxxxxxxxxxxxxxx", "your-api-key-here-0", "changeme-changeme-1", "example_key_1234567890", "<your_token_here_1>", "0000000000000000000000", "${SECRET_TOKEN_1}", "test_token_placeholder_1"])),
                lambda: ("", "-".join(pick(vocabulary) for _ in range(size(3, 7))) + pick(["", "-2024", "_v2"])), lambda: ("= ", "/".join(pick(vocabulary) for _ in range(size(3, 6))) + "/" + chars(string.digits, 2)),
                lambda: (pick(['title = "', 'name: "', 'label = "', "class: ", "type = ", 'heading: "']), "".join(pick(vocabulary) for _ in range(size(2, 5)))), lambda: ("", "".join(pick(vocabulary) for _ in range(size(4, 8)))),
                lambda: (pick(["password: ", "token = ", 'secret = "']), pick(["required", "undefined", "placeholder", "changeme", "yourpassword"])),
                lambda: ("data:image/png;base64,", chars(mixed + "+/", size(40, 120))), lambda: ("", chars(string.digits, size(20, 30))), lambda: ("version: ", ".".join(chars(string.digits, 2) for _ in range(4))),
                lambda: ("= ", "".join(pick(vocabulary).capitalize() for _ in range(size(2, 5))) + chars(string.digits, 1)), lambda: ("", "_".join(pick(vocabulary).upper() for _ in range(size(3, 6))) + "_1"),
            ])()
        before = prose(size(0, 6)) + " "
        text = before + lead + value + pick(['"', "", "", "'"]) + " " + prose(size(0, 4))
        start = len(before) + len(lead)
        kind = next((k for a, b, k in candidates(text) if a < start + len(value) and b > start), pick(["assigned", "run"]))
        rows.append((text, start, start + len(value), kind, path, int(secret)))
    return pd.DataFrame(rows, columns=["text", "start", "finish", "kind", "path", "secret"])


def corpus_dictionary(docs: DataFrame) -> list[str]:
    """The DICTIONARY_WORDS commonest lower-case words of letters over all documents."""
    found = docs.select(F.explode(words(F.lower(F.col("text")))).alias("w")).where(F.col("w").rlike(rf"^[a-z]{{{MIN_LETTERS},16}}$"))
    top = found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY_WORDS)
    return [r["w"] for r in top.select("w").collect()]


def train(findings: pd.DataFrame, dictionary: list[str]) -> Forest:
    """A forest from labelled findings (text, start, finish, kind, path, secret)."""
    known = frozenset(dictionary)
    x = [describe(r.text, r.start, r.finish, r.kind, r.path, known) for r in findings.itertuples()]
    return Forest(np.array(x), findings["secret"].to_numpy(float))


def labelled(findings: DataFrame) -> pd.DataFrame:
    """A table of labelled findings as a frame to train on: all, or the MAX_TRAIN of smallest hash."""
    cols = ["text", "start", "finish", "kind", "path", "secret"]
    return findings.dropna(subset=cols).orderBy(F.xxhash64(*cols)).limit(MAX_TRAIN).select(cols).toPandas()


def _scan(model: Forest, dictionary: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frozenset(dictionary)
        for frame in frames:
            rows, seen = [], []
            for doc_id, path, text in zip(frame["doc_id"].tolist(), frame["path"].tolist(), frame["text"].tolist()):
                for start, end, kind in candidates(text):
                    rows.append((doc_id, start, end - start, kind, text[start:end]))
                    seen.append(describe(text, start, end, kind, path, known))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "kind", "value"])
            yield out.assign(score=model.score(np.array(seen)) if seen else pd.Series(dtype=float))

    return run


def scan(docs: DataFrame, model: Forest, dictionary: list[str], path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, kind, value, score of every candidate the forest scores at ``threshold`` or more.

    ``path`` names a column read as the document's path (null: none). Null and
    empty texts have no findings; null doc_ids are kept as they are; repeated
    rows give their findings once each. Positions count code points. An empty
    table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), where.alias("path"), "text")
    out = rows.mapInPandas(_scan(model, dictionary), "doc_id string, start int, length int, kind string, value string, score double")
    return out.where(F.col("score") >= threshold).withColumn("doc_id", F.col("doc_id").cast(kind))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings in every document, the value as its digest."""
    docs = read(spark, sf_dir, "documents")
    dictionary = corpus_dictionary(docs)
    found = scan(docs, train(composed_findings(dictionary), dictionary), dictionary, path="source")
    return found.select("doc_id", "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), "score")
