"""Secret scans: fixed patterns, and character Markov models of random against ordinary strings.

Two first-order Markov models over the characters of tokens, one of random strings and one of
ordinary identifiers, are trained from labelled samples: a table of the caller's, or strings made here, to which
identifiers are added that are made of the words of documents labelled good, so that the ordinary model knows
the corpus' languages. A candidate is any stretch of MIN_LENGTH token characters or more, wherever it
lies in a run of such; it is a secret when the log-likelihood ratio of the models, per character,
exceeds a threshold between the two classes' held-out samples, and it holds a letter.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written

#: The patterns of the base kinds, and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_HEX_RUN = re.compile(r"[0-9a-f]{%d}" % HEX_LEAST)
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_LENGTH = 20
_SEPARATORS = "+/_=-"
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
#: Shares of held-out ordinary samples above the threshold, and of random ones below it, between which it is laid.
ALARM_RATE, MISS_RATE = 0.001, 0.01
#: Labelled samples of each class that the default training set holds, and documents whose words join it, at most.
SAMPLES, WORD_DOCS = 4000, 2000
#: Words of ordinary identifiers.
VOCABULARY = """
account action address admin alert array async backup batch binary block board bool branch buffer build bundle button cache call
channel check chunk class client clone cloud cluster code column commit config connect console content context control cookie copy
count create cursor data date debug default delete deploy device digest docs domain driver edit element email engine entry error
event export factory field file filter final flag folder font format frame function global graph group handler hash header height
home host html http image import index info input insert item javascript job json key label layer layout length level library
license link list listener load local log main manager map master match memory menu merge message method metric mode model module
""".split()


@dataclass(frozen=True)
class CharModels:
    """Log-likelihood ratio of each pair of characters, random over ordinary, and the threshold."""

    ratio: tuple[tuple[float, ...], ...]  # by previous character (the last row: start), then character
    threshold: float

    def score(self, s: str) -> float:
        """Mean log-likelihood ratio a character; characters outside the alphabet count nothing."""
        at, total, n = len(ALPHABET), 0.0, 0
        for c in s:
            i = _INDEX.get(c)
            if i is not None:
                total += self.ratio[at][i]
                at, n = i, n + 1
        return total / n if n else -math.inf

    def sums(self, s: str) -> np.ndarray:
        """The ratio summed up to each place of a run; separators after separators, as in rulers, speak against it."""
        at, steps, before = len(ALPHABET), [0.0], False
        for c in s:
            i, sep = _INDEX[c], c in _SEPARATORS
            x = self.ratio[at][i]
            steps.append(-abs(x) if sep and before else x)
            at, before = i, sep
        return np.cumsum(steps)

    def best(self, s: str) -> float:
        """The greatest mean ratio of a run's stretches of MIN_LENGTH characters or more; of a shorter run, its mean."""
        c = self.sums(s)
        return max(float((c[w:] - c[:-w]).max()) / w for w in _widths(len(s))) if s else -math.inf


def _widths(n: int) -> range:
    """Lengths of stretches to look at: a longer one consists of some of these, and one of them has no lower mean."""
    return range(MIN_LENGTH, min(2 * MIN_LENGTH, n + 1)) if n >= MIN_LENGTH else range(n, n + 1)


_INDEX = {c: i for i, c in enumerate(ALPHABET)}


def labelled_samples(seed: int = 17, n: int = SAMPLES) -> list[tuple[str, int]]:
    """n random strings (1) of the usual kinds and n ordinary identifiers, paths and slugs (0)."""
    r = random.Random(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], "abcdefghijklmnopqrstuvwxyz0123456789")
    out = []
    for i in range(n):
        size = r.randint(MIN_LENGTH, 64)
        out.append(("".join(r.choices(kinds[i % len(kinds)], k=size)), 1))
        words = r.choices(VOCABULARY, k=r.randint(3, 6))
        if r.random() < 0.7:
            words.insert(r.randrange(len(words) + 1), str(r.randint(0, 2030)))
        camel = words[0] + "".join(w.capitalize() for w in words[1:])
        out.append((r.choice(("_".join(words), "-".join(words), "/".join(words), camel, "_".join(words).upper())), 0))
    return out


def train(samples: DataFrame) -> CharModels:
    """Models from labelled rows (``sample`` string, ``label`` 1 random or 0 ordinary).

    A fifth of the samples, by hash, is held out and sets the threshold, halfway between the score of a best stretch that
    ALARM_RATE of the ordinary ones reach and the one that MISS_RATE of the random ones don't; where these cross, the first
    holds, and with no held-out sample of a class the other's alone. Null samples and labels are left
    out. What comes to the driver is bounded: pair counts of the alphabet, and at most ``SAMPLES`` held-out rows a class.
    """
    rows = samples.where("sample is not null and label in (0, 1)").select("sample", F.col("label").cast("int").alias("label"), (F.pmod(F.xxhash64("sample"), F.lit(5)) == 0).alias("held"))
    chars = F.filter(F.split("sample", ""), lambda c: F.lit(ALPHABET).contains(c) & (c != ""))
    pairs = F.zip_with(F.concat(F.array(F.lit("")), F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0)))), chars, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counts = rows.where("not held").select("label", F.explode(pairs).alias("p")).where("p.b is not null").groupBy("label", "p.a", "p.b").count().collect()
    n = len(ALPHABET)
    seen = [[[1.0] * n for _ in range(n + 1)] for _ in range(2)]
    for label, a, b, k in counts:
        seen[label][_INDEX.get(a, n)][_INDEX[b]] += k
    logs = [[[math.log(x / sum(row)) for x in row] for row in one] for one in seen]
    ratio = tuple(tuple(x - y for x, y in zip(p, q, strict=True)) for p, q in zip(logs[1], logs[0], strict=True))
    model = CharModels(ratio, 0.0)

    def held(label: int) -> list[float]:
        kept = rows.where(f"held and label = {label}").orderBy(F.xxhash64("sample"), "sample").limit(SAMPLES).collect()
        texts = ("".join(c for c in r["sample"] if c in _INDEX) for r in kept)
        return sorted(model.best(t) for t in texts if len(t) >= MIN_LENGTH)

    ordinary, random_ = held(0), held(1)
    alarm = ordinary[-1 - int(len(ordinary) * ALARM_RATE)] if ordinary else None
    miss = random_[int(len(random_) * MISS_RATE)] if random_ else None
    known = [x for x in (alarm, miss) if x is not None]
    between = max(alarm, (alarm + miss) / 2) if len(known) == 2 else known[0] if known else 0.0
    return CharModels(ratio, between)


def identifiers_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ordinary samples (sample, label 0) from words of documents labelled good: three or more words in a row, joined as identifiers are.

    At most WORD_DOCS documents, those of the least hash; words of 2 to 15 letters of the alphabet. No such documents: no rows.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    two = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    chosen = two.select("_id").distinct().join(good, "_id").orderBy(F.xxhash64("_id"), "_id").limit(WORD_DOCS)
    texts = two.join(F.broadcast(chosen), "_id").select("_text")  # WORD_DOCS ids at most
    words = F.filter(F.split("_text", r"[^A-Za-z]+"), lambda w: F.length(w).between(2, 15))
    rows = texts.select(words.alias("w"))
    four = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.slice("w", i * 4 + 1, 4)), lambda p: F.size(p) == 4)
    parts = rows.where("size(w) > 0").select(F.posexplode(four).alias("i", "p"))
    joined = F.when(F.col("i") % 3 == 0, F.array_join("p", "_")).when(F.col("i") % 3 == 1, F.array_join("p", "")).otherwise(F.lower(F.array_join("p", "-")))
    return parts.select(joined.alias("sample"), F.lit(0).alias("label")).where(F.length("sample") >= MIN_LENGTH)


def default_models(spark: SparkSession) -> CharModels:
    """Models from the strings made here alone."""
    return train(spark.createDataFrame(labelled_samples(), "sample string, label int"))


def models_for(docs: DataFrame, labels: DataFrame) -> CharModels:
    """Models from the strings made here and identifiers of the words of documents that ``labels`` calls good."""
    made = docs.sparkSession.createDataFrame(labelled_samples(), "sample string, label int")
    return train(written(made.unionByName(identifiers_of(docs, labels)), "samples"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base kinds: kind, start, end, each kind's matches leftmost and apart."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _HEX_RUN.search(text):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return out


def _stretches(s: str, models: CharModels) -> list[tuple[int, int]]:
    """The whole run if it is above the threshold, else what stretches above it cover, up to the next separators, without ends that speak against it."""
    c = models.sums(s)
    c = c - models.threshold * np.arange(len(c))
    if c[-1] > 0:
        return [(0, len(s))] if any(x.isalpha() for x in s) else []
    edges = np.zeros(len(c) + 1, np.int64)
    for w in _widths(len(s)):
        at = np.flatnonzero(c[w:] - c[:-w] > 0)
        edges[at] += 1
        edges[at + w] -= 1
    covered = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
    out: list[tuple[int, int]] = []
    reach = 2 * MIN_LENGTH
    for lo, hi in zip(np.flatnonzero(covered == 1).tolist(), np.flatnonzero(covered == -1).tolist(), strict=True):
        # ends within reach of the cover's, with the greatest sum between them
        ends = np.arange(max(lo + 1, hi - reach), hi + 1)
        low = np.minimum.accumulate(c[lo : min(lo + reach, hi)])
        b = int(ends[np.argmax(c[ends] - low[np.minimum(ends - lo, len(low)) - 1])])
        a = lo + int(np.argmin(c[lo : min(lo + reach, b)]))
        while a and s[a - 1] not in _SEPARATORS:
            a -= 1
        while b < len(s) and s[b] not in _SEPARATORS:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if any(x.isalpha() for x in s[a:b])]


def model_spans(text: str, models: CharModels) -> list[tuple[str, int, int]]:
    return [("markov", m.start() + a, m.start() + b) for m in _RUN.finditer(text) for a, b in _stretches(m.group(), models)]


def spans_of(text: str, models: CharModels) -> list[tuple[str, int, int]]:
    """All spans by start, then by kind in the order of KINDS; a model's span that meets a base one is left out."""
    base = base_spans(text)
    more = [s for s in model_spans(text, models) if not any(s[1] < e and b < s[2] for _, b, e in base)]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with each stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += (text[at:a], mark)
        at = max(at, b)
    return "".join(out) + text[at:]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SCAN = "doc_id long, spans array<struct<kind:string,start:int,end:int>>, base_sha256 string"
_SCAN_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("base_sha256", pa.string())]
)


def _scan(models: CharModels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, digests = [], []
            for text in b.column(1).to_pylist():
                found = spans_of(text or "", models)
                spans.append([{"kind": k, "start": a, "end": z} for k, a, z in found])
                digests.append(hashlib.sha256(_joined(s for s in found if s[0] != "markov").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SCAN_ARROW.field(1).type), pa.array(digests, pa.string())], schema=_SCAN_ARROW)

    return run


def scan(docs: DataFrame, models: CharModels | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, spans (kind, start, end in code points), base_sha256.

    Null and empty texts have no spans. Null ids and repeated rows: a row each. Empty table: no
    rows. Texts are read whole, however long. Other columns are neither read nor returned.
    """
    models = models or default_models(docs.sparkSession)
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_scan(models), _SCAN)


def redact(docs: DataFrame, models: CharModels | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mark``; all rows and columns stay.

    Null texts stay null. Only the text column goes through Python.
    """
    models = models or default_models(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redacted(t, spans_of(t, models), mark))

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
