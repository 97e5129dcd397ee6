"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Candidates are runs of token characters with a letter among them. Each gets an inferred encoding and three tests of how far it is from a
uniform draw of that encoding's alphabet: chi-squared uniformity, the number of runs above and below the alphabet's middle, and
serial correlation at lag 1, joined by Fisher's method. A token that the battery tells from a uniform draw (p below least_p) is no key.

The battery alone cannot tell a short ordinary token from a key, so a candidate also has to be too unlikely for an ordinary one. What
ordinary tokens look like is a model of character pairs, counted over all runs of the corpus that are too short to be
candidates; tokens in capitals may also be ordinary ones written in capitals. The evidence is the number of bits by which a uniform draw
explains the token better than that model, and 2 ** -evidence is a p-value of `the token is ordinary`: under the model a
likelihood ratio reaches x with a probability of 1 / x at most. It shrinks with the length, so a single long key passes on its own.
Within each (encoding, length class) over all documents the Benjamini-Hochberg rule at rate q chooses what is reported; its kind is
`random`.

Null and edge cases: a null text is empty; a document without spans has empty strings and the hash of the empty string;
repeated rows are scanned each on its own; extra columns are not read; spans count code points, ends exclusive; a corpus without
short runs has a model in which all characters are alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, batches_of, table

#: The patterns of the contract, in order of kind.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Every kept assignment contains this, and every kept access key and hex run lies in a RUN.
ASSIGN_TAIL = re.compile(r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

#: Alphabets by name, the narrowest first.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_INDEX = [(name, {c: i for i, c in enumerate(a)}, frozenset(a)) for name, a in ENCODINGS]
#: Characters of the shortest candidate, and of the shortest run that is too long to be an ordinary token of the model.
LEAST_RANDOM, LONG_RUN = 20, 16
#: Characters of the pair model; 0 is the start of a run.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
STATES = len(CHARACTERS) + 1
_STATE = np.zeros(256, np.int64)
_STATE[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(1, STATES)
#: Weight of a character's own frequency in that of a pair.
PRIOR = 20.0


def infer_encoding(token: str) -> tuple[str, list[int], int] | None:
    """Name, symbol numbers and alphabet size of the narrowest alphabet that holds all characters but padding."""
    body = token.rstrip("=")
    seen = set(body)
    for name, index, alphabet in _INDEX:
        if seen <= alphabet:
            return name, [index[c] for c in body], len(alphabet)
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness_p(symbols: list[int], m: int) -> float:
    """Fisher's combination of the three tests' p-values; small means: not a uniform draw from m symbols."""
    n = len(symbols)
    if n < 3:
        return 1.0
    counts: dict[int, int] = {}
    for s in symbols:
        counts[s] = counts.get(s, 0) + 1
    chi2 = m / n * sum(c * c for c in counts.values()) - n
    # Exact mean and variance of the statistic under uniform sampling, so sparse counts need no asymptotics. Ordinary tokens
    # are uneven, so only that side counts.
    p_chi = math.erfc((chi2 - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n) / math.sqrt(2)) / 2
    high = [s * 2 >= m for s in symbols]
    a = sum(high)
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        p_runs = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    centred = [s - (m - 1) / 2 for s in symbols]
    serial = sum(x * y for x, y in zip(centred, centred[1:])) / ((m * m - 1) / 12 * math.sqrt(n - 1))
    p_serial = _two_sided(serial)
    x = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return min(1.0, math.exp(-x) * (1 + x + x * x / 2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches, sorted."""
    found = []
    if ASSIGN_TAIL.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in RUN.finditer(text):
        part, at = run[0], run.start()
        if "AKIA" in part:
            found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(part) if m.end() - m.start() >= LEAST["access"]]
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(part) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def pair_counts(texts: list[bytes | None]) -> np.ndarray:
    """Pairs of characters that follow each other in runs shorter than LONG_RUN, the first one after 0."""
    state = _STATE[np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], state > 0, [False]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    mark = np.zeros(len(state) + 1, np.int64)
    short = ends - starts < LONG_RUN
    mark[starts[short]] = 1
    mark[ends[short]] -= 1
    at = np.flatnonzero(np.cumsum(mark[:-1]))
    before = np.where(at > 0, state[at - 1], 0)
    return np.bincount(before * STATES + state[at], minlength=STATES * STATES)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(STATES * STATES, np.int64)
    for big in batches:
        for batch in batches_of(pa.Table.from_batches([big]), 1024):
            total += pair_counts(batch.column("text").cast(pa.binary()).to_pylist())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"pair": at, "n": total[at]})


def pair_model(counts: np.ndarray) -> list[list[float]]:
    """Bits of each character after each other one (or at the start of a run): counts of pairs, drawn to those of characters."""
    n = counts.reshape(STATES, STATES).astype(float)
    own = n.sum(axis=0) + 0.5
    own[0] = 0
    own /= own.sum()
    with np.errstate(divide="ignore"):
        return (-np.log2((n + PRIOR * own) / (n.sum(axis=1, keepdims=True) + PRIOR))).tolist()


def ordinary_bits(body: str, model: list[list[float]]) -> float:
    """Bits that the model of ordinary tokens needs for a token; one in capitals may be an ordinary one written so."""

    def bits(t: str) -> float:
        states = [0, *_STATE[np.frombuffer(t.encode(), np.uint8)].tolist()]
        return sum(model[a][b] for a, b in zip(states, states[1:]))

    plain = bits(body)
    if body != body.upper() or body == body.lower():
        return plain
    lowered = bits(body.lower())
    # Half of the one and half of the other.
    return min(plain, lowered) + 1 - math.log2(1 + 2.0 ** -min(1000.0, abs(plain - lowered)))


def candidates(text: str, base: list[tuple[int, int, int]], model: list[list[float]]) -> list[dict]:
    """Runs that the battery judges: a letter at least, no overlap with a base span."""
    out = []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # the furthest end of the spans so far
    for run in RUN.finditer(text):
        token, s, e = run[0], run.start(), run.end()
        body = token.rstrip("=")
        if len(body) < LEAST_RANDOM or not any(c.isalpha() for c in body):
            continue
        before = bisect_left(starts, e)
        if (before and reach[before - 1] > s) or not (enc := infer_encoding(token)):
            continue
        name, symbols, m = enc
        entropy = len(symbols) * math.log2(m)
        out.append({"start": s, "end": e, "encoding": name, "length": len(symbols), "bits": entropy, "uniform_p": randomness_p(symbols, m), "evidence": ordinary_bits(body, model) - entropy})
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CAND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length", pa.int32()), ("bits", pa.float64()), ("uniform_p", pa.float64()), ("evidence", pa.float64())])
SCAN = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start: long, kind: int, end: long>>, "
    "candidates array<struct<start: long, end: long, encoding: string, length: int, bits: double, uniform_p: double, evidence: double>>"
)


def _scan(model: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 1024):
                base = []
                found = []
                for text in batch.column("text").to_pylist():
                    base.append(base_spans(text or ""))
                    found.append(candidates(text or "", base[-1], model))
                said = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans) for spans in base]
                count = lambda kind: pa.array([sum(k == kind for _, k, _ in spans) for spans in base], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_assign": count(0),
                        "n_access": count(1),
                        "n_hex": count(2),
                        "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said]),
                        "base": pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in spans] for spans in base], pa.list_(_SPAN)),
                        "candidates": pa.array(found, pa.list_(_CAND)),
                    }
                )

    return run


def scan_secrets(docs: DataFrame, q: float = 0.05, min_bits: float = 80.0, least_p: float = 0.001) -> DataFrame:
    """doc_id, counts, base_sha256, base and random spans of each document.

    min_bits: alphabet entropy of the weakest key that is looked for; least_p: share of true keys that the battery may take for
    something else. The model is a table of characters by characters. The thresholds come from counts of all candidates in whole bits by
    (encoding, length class): at most a few thousand rows, whatever the input; one a class, they become literals."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = np.zeros(STATES * STATES, np.int64)
    for r in rows.select("text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    scanned = scratch.save(rows.mapInArrow(_scan(pair_model(counts)), SCAN), "scan")
    cls = lambda c: F.concat_ws("/", c["encoding"], F.least(F.floor(F.log2(c["length"]) * 2), F.lit(40)).cast("string"))
    # p-values of 2 ** -bin: rounded up, and one where the battery has spoken.
    bin_of = lambda c: F.when(c["uniform_p"] < least_p, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(c["evidence"])))).cast("int")
    each = scanned.select(F.explode("candidates").alias("c")).where(F.col("c.bits") >= min_bits)
    bins = each.groupBy(cls(F.col("c")).alias("class"), bin_of(F.col("c")).alias("bin")).agg(F.count("*").alias("n"))
    surest = W.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    passed = bins.select("class", "bin", (F.sum("n").over(W.partitionBy("class")) * F.pow(F.lit(2.0), -F.col("bin")) <= q * F.sum("n").over(surest)).alias("ok"))
    limits = {r["class"]: int(r["bin"]) for r in passed.where("ok").groupBy("class").agg(F.min("bin").alias("bin")).collect()}
    pairs = [x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]
    limit = lambda c: F.element_at(F.create_map(*pairs), cls(c)) if pairs else F.lit(None).cast("int")
    kept = F.filter("candidates", lambda c: (c["bits"] >= min_bits) & F.coalesce(bin_of(c) >= limit(c), F.lit(False)))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))).alias("random"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    say = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", "random")), say), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size("random").cast("long").alias("n_random"))
