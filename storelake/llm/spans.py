"""Substring dedup by sliding spans: runs of sentences, and runs of 51 words wherever they begin.

*Sentences.* A text is cut into sentences (after ``.``, ``!`` or ``?`` before white space, after
full-width end marks, and at line ends); a sentence of more than ``LONG`` = 25 words is cut every 25
words. The span of a sentence is the shortest run from it on with ``run`` = 3 sentences and
``least`` = 8 words or more. Every sentence that a span at any other place than its first covers
is removed.

*Words.* A passage may begin or end inside a sentence, or be wrapped at other line ends. So every
run of ``WINDOW`` = 51 words counts too (a character of a script without spaces is a word). Not
all runs are grouped: of the ``GRAM`` = 26 runs of 26 words in a window the one of least
hash is its anchor, the same wherever the window is (winnowing). Anchors are grouped with the
spans, and only windows around anchors that repeat become rows. Every word that a
window at any other place than its first covers is removed; a later place in the same document
counts if it does not overlap the first. Windows whose words the sentence rule removes anyway are left out.

Spans and windows are hashed (words lower-cased, white space collapsed) and grouped over the corpus
by hash. The first place is the one in the document of smallest id, and there the first.

Texts are stored once in compressed blocks, bucketed by block; spans, anchors and windows are narrow
rows. Grouping is a partial aggregate (a span in a third of all documents is one row a task); the
join back to the places is a sort-merge join whose hot spans AQE splits. Only places of repeated
spans go on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.llm.common import STEP, run_dir, run_hashes, span_hashes, text_of, written, written_bucketed
from storelake.llm.quality import _BLOCKS, _blocks, _documents

BLOCK_BYTES = 16 << 20
LONG, RUN, LEAST = 25, 3, 8
WINDOW, GRAM = 51, 26
_LAST_ID = (1 << 63) - 1
_ENDS = re.compile(r"(?:[.!?]+(?=\s)|[\u3002\uff01\uff1f\uff61]+|\n)\s*")
_WORD = re.compile(r"\S+")
_STEP = 2000  # documents whose spans are hashed together
_PLACE = "block long, place int, doc_id long, start int, stop int"

# code points: lower case, and 0 for white space, 1 inside a word, 2 a word of its own (scripts without spaces)
_CHARS = 0x20000
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(_CHARS))], np.uint32)
_KIND = np.array([0 if chr(c).isspace() else 1 for c in range(_CHARS)], np.uint8)
for _a, _b in ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3001, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00), (_CHARS - 1, _CHARS)):
    _KIND[_a:_b] = 2


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of a text, with the white space after each. They cover the text."""
    out, at = [], 0
    for m in [*_ENDS.finditer(text), None]:
        end = m.end() if m else len(text)
        if end == at:
            continue
        said = text[at:end].split()
        if len(said) <= LONG:
            out.append((at, end, said))
        else:
            starts = [w.start() for w in _WORD.finditer(text, at, end)][::LONG]
            starts[0] = at
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], end], strict=True)):
                out.append((a, b, said[k * LONG : (k + 1) * LONG]))
        at = end
    return out


def word_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the words of all texts (code points, one text after the other), each
    text's range of words, and each text's first code point."""
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    units = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    known = np.minimum(units, _CHARS - 1)
    kind = _KIND[known]
    units = np.where(units < _CHARS, _LOWER[known], units)
    edge = np.zeros(len(units) + 1, bool)  # no word goes on across this place
    edge[first] = True
    edge[1:-1] |= (kind[1:] != 1) | (kind[:-1] != 1)
    starts, ends = np.flatnonzero((kind > 0) & edge[:-1]), np.flatnonzero((kind > 0) & edge[1:]) + 1
    return starts, span_hashes(units, starts, ends), np.searchsorted(starts, first), first


def _sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` of every ``n`` values in a row."""
    out, k = x, 1
    while 2 * k <= n:
        out, k = pick(out[:-k], out[k:]), 2 * k
    last = len(x) - n + 1
    return pick(out[:last], out[n - k : n - k + last])


def anchors(h: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows inside a text."""
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(h) - GRAM + 1)
    grams = run_hashes(h, at, at + GRAM)
    inside = np.arange(n) + WINDOW <= np.repeat(ranges[1:], np.diff(ranges))[:n]
    least = np.where(inside, _sliding(grams, WINDOW - GRAM + 1, np.minimum), np.uint64(0))
    none = np.zeros(WINDOW - GRAM, np.uint64)
    most = _sliding(np.concatenate([none, least, none]), WINDOW - GRAM + 1, np.maximum)
    chosen = np.flatnonzero((most == grams) & (most > 0))
    return chosen, grams[chosen]


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``STEP`` characters."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t)
        if size > STEP or j + 1 == len(texts):
            yield i, j + 1
            i, size = j + 1, 0


def _spans(run: int, least: int) -> Callable[[pa.Table], pa.Table]:
    names = ["span", "block", "place", "doc_id", "start", "stop", "again"]

    def rows(block: int, ids: np.ndarray, place: np.ndarray, key: np.ndarray, start: np.ndarray, stop: np.ndarray, again: np.ndarray) -> pa.Table:
        cols = [pa.array(key.view(np.int64)), pa.array(np.full(len(key), block)), pa.array(place.astype(np.int32)), pa.array(ids[place]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(again)]
        return pa.Table.from_arrays(cols, names)

    def said_spans(block: int, ids: np.ndarray, base: int, docs: list[list]) -> pa.Table:
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        h = np.fromiter((xxhash.xxh64_intdigest(" ".join(w).lower()) for d in docs for _, _, w in d), np.uint64, int(size.sum()))
        said = np.fromiter((len(w) for d in docs for _, _, w in d), np.int64, int(size.sum()))
        ends = np.repeat(np.cumsum(size), size)
        first = np.repeat(np.cumsum(size) - size, size)
        upto = np.concatenate([[0], np.cumsum(said)])
        at = np.arange(len(h))
        stop = np.maximum(at + run, np.searchsorted(upto, upto[:-1] + least))
        ok = np.flatnonzero(stop <= ends)
        key = run_hashes(h, ok, stop[ok])
        doc = np.repeat(np.arange(len(docs)), size)[ok]
        # a span that its own document has before
        order = np.lexsort((ok, key, doc))
        again = np.zeros(len(ok), bool)
        again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        return rows(block, ids, base + doc, key, ok - first[ok], stop[ok] - first[ok], again)

    def build(block: pa.Table) -> pa.Table:
        row, raw = _documents(block)
        texts, ids = [t.decode() for t in raw], np.array(row["doc_ids"], np.int64)
        out = [said_spans(row["block"], ids, i, [sentences(t) for t in texts[i : i + _STEP]]) for i in range(0, len(texts), _STEP)]
        for i, j in _parts(texts):
            _, h, ranges, _ = word_runs(texts[i:j])
            at, key = anchors(h, ranges)
            doc = np.searchsorted(ranges, at, "right") - 1
            out.append(rows(row["block"], ids, i + doc, key, at - ranges[doc], np.full(len(at), -1), np.zeros(len(at), bool)))
        return pa.concat_tables(out)

    return build


def _by_place(cuts: pa.Table) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The rows of each place of a block."""
    cols = {c: cuts.column(c).to_numpy() for c in cuts.column_names if c != "block"}
    order = np.argsort(cols["place"], kind="stable")
    cols = {c: x[order] for c, x in cols.items()}
    bounds = np.append(np.flatnonzero(np.diff(cols["place"], prepend=-1)), len(order))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(cols["place"][i]), {c: x[i:j] for c, x in cols.items()}


def _covered(size: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    edges = np.bincount(starts, minlength=size + 1) - np.bincount(stops, minlength=size + 1)
    return np.cumsum(edges[:size]) > 0


def _gone(text: str, hits: dict[str, np.ndarray]) -> tuple[np.ndarray, list, np.ndarray]:
    """Which characters and which sentences the sentence rule removes, and the sentences."""
    units = sentences(text)
    said = hits["stop"] >= 0
    inside = _covered(len(units), hits["start"][said], hits["stop"][said])
    return np.repeat(inside, [b - a for a, b, _ in units]), units, inside


def _windows(block: pa.Table, hits: pa.Table) -> pa.Table:
    """The windows around repeated anchors, but for those that the sentence rule removes whole."""
    number, place, ids, at, keys, again = [], [], [], [], [], []
    row, raw = _documents(block) if block.num_rows else ({}, [])
    for p, own in _by_place(hits):
        anchor = own["start"][own["stop"] < 0].astype(np.int64)
        if not len(anchor):
            continue
        text = raw[p].decode()
        starts, h, _, _ = word_runs([text])
        n = len(h) - WINDOW + 1
        near = _covered(n, np.maximum(anchor - (WINDOW - GRAM), 0), np.minimum(anchor + 1, n))
        left = np.concatenate([[0], np.cumsum(~_gone(text, own)[0][starts])])
        s = np.flatnonzero(near & (left[WINDOW:] > left[:-WINDOW]))
        key = run_hashes(h, s, s + WINDOW)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        at.append(s)
        keys.append(key)
        again.append(s - s[first][back] >= WINDOW)
        place.append(np.full(len(s), p))
        ids.append(np.full(len(s), row["doc_ids"][p]))
        number.append(np.full(len(s), row["block"]))
    whole = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    start = whole(at, np.int32)
    cols = [whole(keys, np.uint64).view(np.int64), whole(number, np.int64), whole(place, np.int32), whole(ids, np.int64), start, start + np.int32(WINDOW), whole(again, bool)]
    return pa.Table.from_arrays([pa.array(c) for c in cols], ["span", "block", "place", "doc_id", "start", "stop", "again"])


def _clean(block: pa.Table, cuts: pa.Table) -> pa.Table:
    row, raw = _documents(block)
    n = len(raw)
    count, chars, copied, out = [0] * n, [0] * n, [[] for _ in range(n)], [t.decode() for t in raw]
    for p, own in _by_place(cuts):
        text = out[p]
        gone, units, inside = _gone(text, own | {"stop": np.where(own["words"], -1, own["stop"])})
        words = own["words"].astype(bool)
        if words.any():
            starts = word_runs([text])[0]
            lost = _covered(len(starts), own["start"][words], own["stop"][words])
            size = np.diff(np.append(starts, len(text)))  # a word goes with the white space after it
            gone[starts[0] :] |= np.repeat(lost, size)
            first = np.searchsorted(starts, [a for a, _, _ in units] + [len(text)])
            upto = np.concatenate([[0], np.cumsum(lost | gone[starts])])[first]
            inside |= (np.diff(first) > 0) & (np.diff(upto) == np.diff(first))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]])))
        out[p] = "".join(text[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        count[p], chars[p] = int(inside.sum()), len(text) - len(out[p])
        copied[p] = [x for x in np.unique(own["holder"]).tolist() if x < _LAST_ID]
    ids = pa.array([x if x < _LAST_ID else None for x in row["doc_ids"]], pa.int64())
    cols = [ids, pa.array(count, pa.int64()), pa.array(chars, pa.int64()), pa.array(copied, pa.list_(pa.int64())), pa.array(out, pa.string())]
    return pa.Table.from_arrays(cols, ["doc_id", "n_removed", "removed_chars", "copied_from", "clean_text"])


def _repeated(spans: DataFrame, path: str) -> DataFrame:
    """(span, holder) of the spans at more than one place: a side of its own, so that AQE may split a hot span on the other."""
    return written(spans.groupBy("span").agg(F.min("doc_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("span", "holder"), path)


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_removed, removed_chars, copied_from, clean_text``.

    ``n_removed`` counts sentences removed whole, ``removed_chars`` all that went, ``copied_from`` lists the documents that hold the
    first places of the removed spans (sorted; empty where nothing is removed). Null texts count as
    empty. A null id comes after all others. Rows that repeat an id count as one document and
    are cleaned each by its own text. Columns other than id and text are not read. Empty input,
    empty result."""
    spark = docs.sparkSession
    path = run_dir(spark, "spans")
    none = F.lit(0).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("doc_id"), none.alias("text_key"), F.lit("").alias("lang"), text_of(text_col).alias("text"))
    blocks = written_bucketed(rows.mapInArrow(_blocks(block_bytes), _BLOCKS), f"{path}/blocks", "block").select("block", "doc_ids", "keys", "langs", "sizes", "texts")
    spans = written(blocks.groupBy("block").applyInArrow(_spans(run, least), f"span long, {_PLACE}, again boolean"), f"{path}/spans")
    place = ["block", "place", "doc_id", "start", "stop", "holder"]
    hits = spans.join(_repeated(spans, f"{path}/repeated"), "span").where("stop < 0 OR again OR doc_id <> holder")
    hits = written(hits.select(*place), f"{path}/hits")
    windows = blocks.groupBy("block").cogroup(hits.drop("holder", "doc_id").groupBy("block")).applyInArrow(_windows, f"span long, {_PLACE}, again boolean")
    windows = written(windows, f"{path}/windows")
    later = windows.join(_repeated(windows, f"{path}/again"), "span").where("again OR doc_id <> holder").select(*place)
    cuts = hits.where("stop >= 0").withColumn("words", F.lit(False)).unionByName(later.withColumn("words", F.lit(True)))
    # the spans of a document are bounded by its sentences and words
    cuts = cuts.select("block", "place", "start", "stop", "holder", "words")
    return blocks.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_clean, "doc_id long, n_removed long, removed_chars long, copied_from array<long>, clean_text string")
