"""Periodic runs of words, found on a Re-Pair grammar of each document.

A run is a stretch of words ``[s, e)`` with smallest period ``q`` (words ``q`` apart are equal), of at
least ``max(LEAST, 2 q)`` words, that no neighbouring word extends.

1. *Re-Pair.* The word ids of a document are replaced pair by pair. A round does the work of many
   single replacements at once: every pair that occurs twice or more in its document, and more often than
   the pairs that overlap it (ties by number), becomes a nonterminal. Rounds go on until no pair occurs
   twice; what is left of a document is joined by a balanced binary tree, so that the
   whole document hangs under one symbol.
2. *Boundaries.* A run lies inside exactly one lowest node that holds it whole, and crosses the boundary of
   that node's two children. So for every nonterminal, once, runs across its boundary are looked
   for: a run of at least ``LEAST`` = 12 words repeats one of the two word triples that touch the boundary
   at distance ``q``, and two longest common extensions give its ends.
3. *Positions.* Each run found in a nonterminal stands at all positions that derive it. Intervals of one
   period that share a period's length are merged, the whole ones swallow the cut ones, and of equal
   intervals the smallest period stays.

Extensions compare hashes of two 31-bit primes; every run is checked on the words at the end. Each document is
one row and is worked on alone, several documents in one set of numpy arrays. Time is
O(n log n) words where triples rarely repeat outside of runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.llm.common import buffers, mix, plain, ship, slices, text_of

LEAST = 12
_TRIPLE = 3  # LEAST / 4: the shorter of two extensions that make up LEAST - q or q words has this many
_CHUNK = 1 << 20  # candidates looked at together
_BYTES = 2 << 20  # text worked on at once
_PRIMES = ((2147483647, 1099087573), (2147483629, 1934251447))


def _starts(doc: np.ndarray) -> np.ndarray:
    """For each place, the first place of its document (``doc`` is sorted)."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    return at[np.cumsum(new) - 1]


def re_pair(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the grammars: (rule, start, middle, end) of every position that derives a rule, as rows of
    one array, and the axioms' symbols as rows (doc, start, end).

    ``symbols`` are ids below 2 ** 31 that differ between documents; ``doc`` is sorted."""
    n = len(symbols)
    symbol, start, end = symbols.astype(np.int64), np.arange(n), np.arange(1, n + 1)
    nodes, done, base = [], [], int(symbols.max(initial=-1)) + 1
    while len(symbol) > 1:
        key = (symbol[:-1] << 32) | symbol[1:]
        inside = np.flatnonzero(doc[:-1] == doc[1:])
        kinds, number, count = np.unique(key[inside], return_inverse=True, return_counts=True)
        order = np.full(len(symbol) + 1, -1, np.int64)  # of pair i at i + 1, with an edge on both sides
        order[inside + 1] = count[number] * np.int64(len(kinds)) + number
        often = np.zeros(len(symbol) + 1, bool)
        often[inside + 1] = count[number] > 1
        # neighbouring equal pairs (aaa) stand and fall together; every other one is taken
        new = np.ones(len(order), bool)
        new[1:] = order[1:] != order[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        of = order[first]
        top = np.ones(len(first), bool)
        top[1:] &= of[1:] > of[:-1]
        top[:-1] &= of[:-1] > of[1:]
        take = top[group] & often & ((np.arange(len(order)) - first[group]) % 2 == 0)
        at = np.flatnonzero(take) - 1
        if not len(at):
            break
        rules, rule = np.unique(order[at + 1], return_inverse=True)
        nodes.append(np.stack([rule + base, start[at], start[at + 1], end[at + 1]]))
        symbol[at], end[at] = rule + base, end[at + 1]
        base += len(rules)
        left = np.ones(len(symbol), bool)
        left[at + 1] = False
        busy = np.zeros(int(doc[-1]) + 1, bool)
        busy[doc[at]] = True
        rest = left & ~busy[doc]
        done.append(np.stack([doc[rest], start[rest], end[rest]]))
        left &= busy[doc]
        symbol, start, end, doc = symbol[left], start[left], end[left], doc[left]
    done.append(np.stack([doc, start, end]))
    axiom = np.concatenate(done, axis=1)
    found = np.concatenate(nodes, axis=1) if nodes else np.zeros((4, 0), np.int64)
    return found, axiom[:, np.argsort(axiom[1], kind="stable")]


def balanced(axiom: np.ndarray) -> np.ndarray:
    """Nodes (start, middle, end) of a balanced binary tree over each document's axiom."""
    doc, start, end = axiom
    out = []
    while len(doc) > 1:
        at = np.flatnonzero((doc[:-1] == doc[1:]) & ((np.arange(len(doc)) - _starts(doc))[:-1] % 2 == 0))
        if not len(at):
            break
        out.append(np.stack([start[at], start[at + 1], end[at + 1]]))
        end = end.copy()
        end[at] = end[at + 1]
        left = np.ones(len(doc), bool)
        left[at + 1] = False
        doc, start, end = doc[left], start[left], end[left]
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


class _Extensions:
    """Longest common extensions of two places of one sequence."""

    def __init__(self, symbols: np.ndarray):
        self.tables = []
        for prime, base in _PRIMES:
            power = np.ones(1, np.uint64)
            step = base
            while len(power) <= len(symbols):
                power = np.concatenate([power, power * np.uint64(step) % np.uint64(prime)])
                step = step * step % prime
            values = mix(symbols.astype(np.uint64) + np.uint64(base)) % np.uint64(prime)
            total = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(values * power[: len(symbols)] % np.uint64(prime), out=total[1:])
            self.tables.append((np.uint64(prime), power, total % np.uint64(prime)))

    def _equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` symbols from ``a`` and from ``b`` >= ``a`` are the same."""
        same = np.ones(len(a), bool)
        for prime, power, total in self.tables:
            one = (total[a + n] + prime - total[a]) % prime * power[b - a] % prime
            same &= one == (total[b + n] + prime - total[b]) % prime
        return same

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self._longest(a, b, most, 0)

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self._longest(a, b, most, 1)

    def _longest(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: int) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.maximum(most, 0)
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self._equal(a - back * half, b - back * half, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low


def _triples(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Number of the three words from each place (equal numbers for equal words); -1 where fewer are left."""
    out = np.full(len(symbols), -1, np.int64)
    if len(symbols) < _TRIPLE:
        return out
    two = np.unique((symbols[:-1] << 32) | symbols[1:], return_inverse=True)[1]
    three = np.unique((two[:-1] << 32) | symbols[2:], return_inverse=True)[1]
    inside = doc[:-2] == doc[2:]
    out[:-2][inside] = three[inside]
    return out


def _crossing(nodes: np.ndarray, triple: np.ndarray, extend: Callable[[], _Extensions]) -> np.ndarray:
    """Rows (node, start, end, period): the periodic intervals of each node that touch its boundary, as far as the node goes."""
    low, middle, high = nodes
    n = np.int64(len(triple) + 1)
    places = np.flatnonzero(triple >= 0)
    index = np.sort(triple[places] * n + places)
    asked, first, count, origin = [], [], [], []
    for off in (0, -_TRIPLE):
        at = middle + off
        fits = np.flatnonzero((at >= low) & (at + _TRIPLE <= high))
        of = triple[at[fits]] * n
        a = np.searchsorted(index, of + low[fits])
        b = np.searchsorted(index, of + high[fits] - _TRIPLE, "right")
        more = b - a > 1
        asked.append(fits[more])
        first.append(a[more])
        count.append((b - a)[more])
        origin.append(at[fits][more])
    asked, first, count, origin = (np.concatenate(x) for x in (asked, first, count, origin))

    def evaluate(node: np.ndarray, period: np.ndarray) -> np.ndarray:
        out = [np.zeros((4, 0), np.int64)]
        lo, mid, hi = low[node], middle[node], high[node]
        for shift in (0, 1):  # the run holds a whole period after the boundary, or one before it
            a = mid - shift * period
            b = a + period
            fits = (a >= lo) & (b <= hi)
            x, y, q, k = a[fits], b[fits], period[fits], node[fits]
            if len(x):
                s = x - extend().backward(x, y, x - lo[fits])
                e = y + extend().forward(x, y, hi[fits] - y)
                long = e - s >= np.maximum(LEAST, 2 * q)
                out.append(np.stack([k[long], s[long], e[long], q[long]]))
        return np.concatenate(out, axis=1)

    out = [np.zeros((4, 0), np.int64)]
    ends = np.cumsum(count)
    i = 0
    while i < len(asked):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CHUNK, "right")))
        many = count[i:j]
        node = np.repeat(asked[i:j], many)
        place = np.repeat(first[i:j] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        period = np.abs(index[place] % n - np.repeat(origin[i:j], many))
        good = (period > 0) & (2 * period <= high[node] - low[node])
        pair = np.unique(node[good] * n + period[good])
        for last in (False, False, True):
            now = np.ones(len(pair), bool)
            if not last:  # the least period of each node first
                now[1:] = pair[1:] // n != pair[:-1] // n
            found = evaluate(pair[now] // n, pair[now] % n)
            out.append(found)
            # a period that fills the node leaves only its own multiples there
            whole = found[0][(found[1] == low[found[0]]) & (found[2] == high[found[0]])]
            pair = pair[~now]
            pair = pair[~np.isin(pair // n, whole)]
        i = j
    return np.concatenate(out, axis=1)


def find_runs(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (doc, start, length, period) of all runs, by document, start and period; starts count from the document's.

    ``symbols`` are word ids, ``offsets`` the documents' bounds among them."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(symbols):
        return np.zeros((0, 4), np.int64)
    own = np.unique(doc * (np.int64(symbols.max()) + 1) + symbols, return_inverse=True)[1]
    derived, axiom = re_pair(own, doc)
    derived = derived[:, derived[3] - derived[1] >= LEAST]
    rules, once = np.unique(derived[0], return_index=True)
    tree = balanced(axiom)
    tree = tree[:, tree[2] - tree[0] >= LEAST]
    nodes = np.concatenate([derived[1:, once], tree], axis=1)
    held: list[_Extensions] = []

    def extensions() -> _Extensions:
        if not held:
            held.append(_Extensions(own))
        return held[0]

    node, start, end, period = _crossing(nodes, _triples(own, doc), extensions)
    if not len(node):
        return np.zeros((0, 4), np.int64)
    # to all positions that derive the rule
    in_rule = node < len(rules)
    order = np.argsort(derived[0], kind="stable")
    by_rule, at = derived[0][order], derived[1][order]
    rule = rules[node[in_rule]]
    a, b = np.searchsorted(by_rule, rule), np.searchsorted(by_rule, rule, "right")
    times = b - a
    where = at[np.repeat(a - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    moved = where - np.repeat(nodes[0][node[in_rule]], times)
    s = np.concatenate([np.repeat(start[in_rule], times) + moved, start[~in_rule]])
    e = np.concatenate([np.repeat(end[in_rule], times) + moved, end[~in_rule]])
    q = np.concatenate([np.repeat(period[in_rule], times), period[~in_rule]])
    # merge intervals of one document and period that share a period's length
    d = doc[s]
    order = np.lexsort((-e, s, q, d))
    merged: list[list[int]] = []
    for x in zip(d[order].tolist(), q[order].tolist(), s[order].tolist(), e[order].tolist(), strict=True):
        last = merged[-1] if merged else None
        if last and last[:2] == [x[0], x[1]] and last[3] - x[2] >= x[1]:
            last[3] = max(last[3], x[3])
        else:
            merged.append(list(x))
    least: dict[tuple[int, int, int], int] = {}
    for d0, q0, s0, e0 in merged:
        if (least.get((d0, s0, e0), q0 + 1)) > q0 and np.array_equal(own[s0 : e0 - q0], own[s0 + q0 : e0]):
            least[d0, s0, e0] = q0
    rows = sorted((d0, s0 - int(offsets[d0]), q0, e0 - s0) for (d0, s0, e0), q0 in least.items())
    return np.array([(d0, s0, n0, q0) for d0, s0, q0, n0 in rows], np.int64).reshape(-1, 4)


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run, or in the first period of every run that holds them."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(plain(batch.column(1)))
        for i, j in slices(offsets, _BYTES):
            said = [data[a:b].tobytes().split() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
            size = np.fromiter(map(len, said), np.int64, len(said))
            known: dict[bytes, int] = {}
            ids = np.fromiter((known.setdefault(w, len(known)) for words in said for w in words), np.int64, int(size.sum()))
            found = find_runs(ids, np.concatenate([[0], np.cumsum(size)]))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in said]
            for d, start, length, period in found.tolist():
                runs[d].append((start, length, period))
            cells = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in mine] for mine in runs]
            text = [_collapsed(words, mine).decode() for words, mine in zip(said, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(cells, _RUNS), pa.array(text, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, runs, collapsed``.

    Words are the maximal runs of characters other than space and U+0009 to U+000D. ``runs`` are
    sorted by start, then period; ``collapsed`` is the text's words, joined by one space, without those
    that a run repeats (they stand after the first period of a run that holds them). Null, empty and blank
    texts have no words, no runs and an empty collapsed text; ids may be null or repeated and rows may
    be equal, since each row is worked on alone; other columns are not read; an empty table gives an empty
    result. Of runs on the same words only the smallest period counts; runs may overlap otherwise."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_scan, SCHEMA)
