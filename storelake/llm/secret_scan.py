"""Secret scans: base patterns, and a battery of randomness tests over all token strings.

Every maximal run of characters of ``[A-Za-z0-9+/_=-]`` is split at ``=`` (NAME=value), and
a piece of ``SHORTEST`` = 12 or more characters that mixes letters and digits is a candidate. So are its
parts between ``/``, and those between ``/``, ``-`` and ``_`` (a key in a path or behind a prefix). The encoding is
inferred from the characters used (hex, base32, lower-case and upper-case alphanumeric, base64; a string of
one case with ``-`` or ``_``, such as a UUID, is judged without them and as a class of its own), and under
the hypothesis that a candidate is random in that alphabet three tests give p-values:

* chi-squared uniformity over the alphabet (Wilson-Hilferty form); where fewer than five of each
  symbol are expected the alphabet is merged into vowels, consonants (by case), digits and signs,
* the runs test about the alphabet's middle,
* lag-1 serial correlation of the symbols' numbers.

Fisher's method combines them. A small p-value speaks for text or an identifier, not for a
random string. Benjamini-Hochberg control at level ``level`` over all candidates of one encoding
and length class (a string of 20 characters carries less evidence than one of 200, so classes are
tested apart) decides which candidates are called text; the others are reported as ``random``.
The counts behind it cover the whole corpus: a partial aggregate by class and p-value step.

Candidates inside a base span are not reported again, nor parts of a reported string.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.common import plain, run_dir, text_of, written

# Fixed values (contract): the base patterns, their order and least lengths.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as long as a maximal run of 32 or more
_WORDS = ("password", "passwd", "secret", "token", "api")
SHORTEST = 12
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % SHORTEST)  # maximal between "=" too
_PARTS = [re.compile(r"[A-Za-z0-9+_-]{%d,}" % SHORTEST), re.compile(r"[A-Za-z0-9+]{%d,}" % SHORTEST)]

# Alphabets by encoding, the most special first.
ALPHABETS = {
    "hex": ["0123456789abcdef", "0123456789ABCDEF"],
    "base32": ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"],
    "lower": ["abcdefghijklmnopqrstuvwxyz0123456789"],
    "upper": ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"],
    "base64": ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"],
}


def _merged(alphabet: str) -> np.ndarray:
    """Class of each symbol: vowels and other letters by case, digits, signs."""
    kind = [(c.isalpha(), c.isupper(), c.lower() in "aeiou") if c.isalpha() else (False, c.isdigit()) for c in alphabet]
    return np.array([sorted(set(map(str, kind))).index(str(k)) for k in kind])


_TABLES = [(name, frozenset(a), {c: i for i, c in enumerate(a)}, _merged(a)) for name, alphabets in ALPHABETS.items() for a in alphabets]
LEVEL, STEPS = 0.05, 10  # p-values are kept in steps of a tenth of a decade
_MOST = 300 * STEPS


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(symbols: np.ndarray, merged: np.ndarray) -> float:
    """Combined p-value of the hypothesis that ``symbols`` are random in an alphabet whose
    symbols have the classes ``merged``."""
    n, size = len(symbols), len(merged)
    cells = np.arange(size) if n >= 5 * size else merged
    expected = np.bincount(cells) * n / size
    count = np.bincount(cells[symbols], minlength=len(expected))
    chi = float(((count - expected) ** 2 / expected).sum())
    d = len(expected) - 1
    p1 = _upper(((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    high = symbols * 2 >= size
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = 2 * _upper(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p2 = 2 * 0.5**n
    x = symbols - symbols.mean()
    spread = float((x * x).sum())
    r = float((x[1:] * x[:-1]).sum()) / spread if spread else 1.0
    p3 = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-half) * (1 + half + half * half / 2)


def candidate(token: str) -> tuple[str, float] | None:
    """(encoding, p-value) of a token string, None where it is no candidate."""
    body = token.rstrip("=")
    if len(body) < SHORTEST or not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body)):
        return None
    group = ""
    if ("-" in body or "_" in body) and (body == body.lower() or body == body.upper()):
        body, group = body.replace("-", "").replace("_", ""), "-groups"
        if len(body) < SHORTEST:
            return None
    used = frozenset(body)
    for name, allowed, number, merged in _TABLES:
        if used <= allowed:
            if name == "base64" and not (any(c.islower() for c in body) and any(c.isupper() for c in body)):
                return None
            return name + group, battery(np.array([number[c] for c in body]), merged)
    return None


def candidates(text: str) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, encoding, p-value) of the candidates of a text: pieces and their parts."""
    for m in _TOKEN.finditer(text):
        places = {m.span()}
        if "/" in m.group() or "-" in m.group() or "_" in m.group():
            places |= {x.span() for part in _PARTS for x in part.finditer(text, m.start(), m.end())}
        for start, stop in sorted(places):
            found = candidate(text[start:stop])
            if found:
                yield start, stop, *found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("encoding", pa.string()), ("size", pa.int32()), ("step", pa.int32())]))]
    for batch in batches:
        rows = []
        for text in plain(batch.column(1)).to_pylist():
            base = base_spans(text)
            maybe = []
            for start, stop, encoding, p in candidates(text):
                if any(a <= start and stop <= b for a, _, b in base):
                    continue
                step = min(_MOST, int(-math.log10(max(p, 1e-300)) * STEPS))  # rounded towards larger p
                maybe.append({"start": start, "stop": stop, "encoding": encoding, "size": (stop - start).bit_length(), "step": step})
            n = [sum(1 for x in base if x[1] == k) for k in range(3)]
            rows.append((*n, [{"start": a, "kind": k, "stop": b} for a, k, b in base], maybe))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base", "maybe"])


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<start:long,kind:int,stop:long>>, maybe array<struct<start:long,stop:long,encoding:string,size:int,step:int>>"


def called_text(candidates: DataFrame, level: float) -> DataFrame:
    """(encoding, size, least): candidates of a class with a step of ``least`` or more are called text.

    Benjamini-Hochberg on counts by step: the largest p = 10 ** (-step / STEPS) with
    p <= level * (candidates with such a p or less) / (all candidates of the class)."""
    by = ["encoding", "size"]
    steps = candidates.groupBy(*by, "step").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumn("below", F.sum("n").over(upto)).withColumn("m", F.sum("n").over(Window.partitionBy(*by)))
    p = F.pow(F.lit(10.0), -F.col("step") / STEPS)
    return ranked.where(p <= F.lit(level) * F.col("below") / F.col("m")).groupBy(*by).agg(F.min("step").alias("least"))


def _render(least: dict[tuple[str, int], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, shown = [], []
            for base, maybe in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                own = [(x["start"], x["kind"], x["stop"]) for x in base]
                digests.append(hashlib.sha256(_shown(own).encode()).hexdigest())
                more = [x for x in maybe if x["step"] < least.get((x["encoding"], x["size"]), _MOST + 1)]
                last, outer = -1, []
                for x in sorted(more, key=lambda x: (x["start"], -x["stop"])):
                    if x["stop"] > last:
                        last = x["stop"]
                        outer.append((x["start"], 3, last))
                shown.append(_shown(sorted(own + outer)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests, pa.string()), pa.array(shown, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return render


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` lists kind:start:end by start, then kind (code points, end exclusive); ``base_sha256``
    is the digest of the same list of base spans. Null and empty texts have none. Ids may be null
    or repeated; other columns are not read. Empty input, empty result."""
    spark = docs.sparkSession
    path = run_dir(spark, "secrets")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = written(rows.mapInArrow(_find, _FOUND), f"{path}/found")
    candidates = found.select(F.explode("maybe").alias("c")).select("c.encoding", "c.size", "c.step")
    # one row a class: ten encodings, lengths by powers of two
    least = {(r["encoding"], r["size"]): r["least"] for r in called_text(candidates, level).collect()}
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return found.mapInArrow(_render(least), schema)
