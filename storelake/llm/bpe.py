"""Byte-level BPE by a global shuffle of distinct words.

1. *Blocks.* Texts are split into pre-tokens, exploded with their positions and
   pre-aggregated over blocks of about ``block_bytes`` of text: a block keeps its
   distinct words once and, for every position, the number of its word. Blocks
   are a table in the shared folder, bucketed by block.
2. *Words.* The blocks' words are shuffled by word. Sorted, every distinct word
   of the corpus is merged once by the ranks and its ids go back to all blocks that
   asked, packed by block. A frequent word is one row a block, not one an occurrence.
3. *Reassembly.* Ids join their block (the bucketed table is not moved) and are
   laid out by position.
4. *Decoding* joins ids to the table of token bytes in the same way: by distinct
   word, then by position. The decoded text is held against the checksum of the
   original, so a wrong id fails the job instead of passing on.

The vocabulary is the only broadcast (ranks: one entry a token, 50,256 for the
file in use).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelake.llm.common import STEP, buffers, give_back, giving_back, plain, run_dir, slices, span_hashes, written_bucketed

BLOCK_BYTES = 32 << 20

# --------------------------------------------------------------------------- pre-tokens

_OTHER, _SPACE, _LETTER, _NUMBER = range(4)
# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions that the public pattern splits off.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Kind of every code point (built once a worker)."""
    global _kinds
    if _kinds is None:
        kind = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = _SPACE
        _kinds = table
    return _kinds


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the pre-tokens of all documents, and each document's range.

    The matches of the public byte-level BPE pattern cover the text, so they are
    given by their starts: a run of letters, of numbers or of other signs, with one
    plain space before it where there is one; white space otherwise, whose last
    character stands alone before a run; and contractions."""
    n_bytes = len(data)
    if not n_bytes:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cps)
    kind = kinds()[cps]
    bounds = np.searchsorted(at, offsets)
    new_doc = np.zeros(n + 1, bool)
    new_doc[bounds] = True
    run = new_doc[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # the last white space before a run of the same document is a start; a plain space takes the run with it
    follows = np.flatnonzero(run[1:] & ~new_doc[1:n] & (kind[:-1] == _SPACE)) + 1
    start[follows - 1] = True
    start[follows[cps[follows - 1] == 0x20]] = False
    quote = np.flatnonzero((cps[:-1] == 0x27) & start[:-1] & run[1:] & ~new_doc[1:n] & (kind[1:] == _LETTER))
    for i in quote[run[quote]].tolist():
        for c in CONTRACTIONS:
            j = i + 1 + len(c)
            if j <= n and all(cps[i + 1 + k] == ord(x) for k, x in enumerate(c)) and not new_doc[i + 1 : j].any():
                start[i + 1] = False
                if j < n:
                    start[j] = True
                break
    starts = at[start]
    return starts, np.append(starts[1:], n_bytes), np.searchsorted(starts, offsets)


# --------------------------------------------------------------------------- merges


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file (base64 token, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of lowest rank merges first, of equal ranks the leftmost."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pair = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pair):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pair[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts here, 0 once it is merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (r := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (r, a, end[b]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != stop:
            continue
        end[a], end[b] = stop, 0
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


# --------------------------------------------------------------------------- blocks

_BLOCKS = "block long, doc_ids array<long>, positions array<long>, counts array<int>, checks array<long>, order binary, words binary, sizes binary"


def _pack(a: np.ndarray) -> bytes:
    """Compressed byte planes of unsigned numbers (small numbers leave the high planes empty)."""
    planes = np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4)
    packing = zstandard.ZstdCompressor(level=3).compressobj(size=planes.size)
    return b"".join([*(packing.compress(planes[:, k].tobytes()) for k in range(4)), packing.flush()])


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Block:
    """Documents of one block on their way to a row."""

    def __init__(self) -> None:
        self.bytes = 0
        self.ids, self.positions, self.counts, self.checks, self.parts = [], [], [], [], []

    def add(self, ids: list, positions: list, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, ranges = pre_tokens(data, offsets)
        h, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        said = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self.parts.append((h, said, number.astype(np.uint32)))
        self.ids += ids
        self.positions += positions
        self.counts += np.diff(ranges).tolist()
        self.checks += [xxhash.xxh64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.bytes += len(data)

    def row(self, number: int) -> pa.RecordBatch:
        h = np.concatenate([p[0] for p in self.parts])
        said = [w for p in self.parts for w in p[1]]
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        shift = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        order, at = np.empty(sum(len(p[2]) for p in self.parts), np.uint32), 0
        for p, s in zip(self.parts, shift, strict=False):
            order[at : at + len(p[2])] = back[p[2] + s]
            at += len(p[2])
        rank = np.argsort(-np.bincount(order, minlength=len(first)), kind="stable")  # frequent words get small numbers
        place = np.empty(len(rank), np.uint32)
        place[rank] = np.arange(len(rank))
        chosen = [said[i] for i in first[rank].tolist()]
        sizes = np.fromiter(map(len, chosen), np.uint32, len(chosen))
        words = zstandard.ZstdCompressor(level=3).compress(b"".join(chosen))
        cols = [
            pa.array([number], pa.int64()),
            pa.array([self.ids], pa.list_(pa.int64())),
            pa.array([self.positions], pa.list_(pa.int64())),
            pa.array([self.counts], pa.list_(pa.int32())),
            pa.array([self.checks], pa.list_(pa.int64())),
            pa.array([_pack(place[order])], pa.binary()),
            pa.array([words], pa.binary()),
            pa.array([_pack(sizes)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "positions", "counts", "checks", "order", "words", "sizes"])


def _blocks(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, block = (context.partitionId() if context else 0) << 32, _Block()
        for batch in batches:
            ids, positions = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, offsets = buffers(plain(batch.column(1)))
            for i, j in slices(offsets, STEP):
                block.add(ids[i:j], positions[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if block.bytes >= block_bytes:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.row(number)
        del block
        give_back()

    return build


def _split(words: bytes, sizes: bytes) -> pa.Array:
    """The words of a block as a binary column."""
    raw, size = zstandard.ZstdDecompressor().decompress(words), _unpack(sizes)
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, words, sizes in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "sizes")), strict=True):
            word = _split(words, sizes)
            order = pc.sort_indices(word)  # neighbours share beginnings: the shuffle compresses better
            for i in range(0, len(word), 50_000):
                place = order.slice(i, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), block)), place.cast(pa.int32()), word.take(place)], ["block", "place", "word"])


def _encode(ranks, flush: int = 500_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pieces(blocks: list[np.ndarray], places: list[np.ndarray], ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        """One row for each block: the places of its words among these, and their ids."""
        block, place = np.concatenate(blocks), np.concatenate(places)
        order = np.lexsort((place, block))
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for mine in np.split(order, cuts):
            found = [ids[i] for i in mine.tolist()]
            counts = np.fromiter((len(x) // 4 for x in found), np.uint32, len(found))
            cols = [_pack(np.diff(place[mine], prepend=0)), _pack(counts), _pack(np.frombuffer(b"".join(found), "<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array([int(block[mine[0]])]), *(pa.array([c], pa.binary()) for c in cols)], ["block", "places", "counts", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        last, now = None, b""
        blocks, places, ids = [], [], []
        for batch in batches:
            for word in batch.column(2).to_pylist():  # sorted: equal words follow each other
                if word != last:
                    last, now = word, np.array(merge(word, table), "<u4").tobytes()
                ids.append(now)
            blocks.append(batch.column(0).to_numpy())
            places.append(batch.column(1).to_numpy())
            if len(ids) >= flush:
                yield from pieces(blocks, places, ids)
                blocks, places, ids = [], [], []
        if ids:
            yield from pieces(blocks, places, ids)
        del blocks, places, ids
        give_back()

    return encode


def _reassemble(ranks, with_ids: bool, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def lay_out(block: pa.Table, words: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0].as_py() for c in ("doc_ids", "positions", "counts", "checks", "order")}
        table = ranks.value
        token = _token_bytes(table)
        order = _unpack(row["order"])
        n = int(order.max()) + 1 if len(order) else 0
        text, raw = [""] * n, [b""] * n
        first, size = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of a word: its ids are said[first : first + size]
        said, at = [np.zeros(0, np.uint32)], 0
        for places, counts, ids in zip(*(words.column(c) for c in ("places", "counts", "ids")), strict=True):
            found, many, place = _unpack(ids.as_py()), _unpack(counts.as_py()).astype(np.int64), np.cumsum(_unpack(places.as_py()), dtype=np.int64)
            ends = np.cumsum(many)
            first[place], size[place] = at + ends - many, many
            flat = found.tolist()
            for p, a, b in zip(place.tolist(), (ends - many).tolist(), ends.tolist(), strict=True):
                text[p], raw[p] = ",".join(map(str, flat[a:b])), b"".join([token[i] for i in flat[a:b]])
            if with_ids:
                said.append(found)
                at += len(found)
        said = np.concatenate(said)
        out: list[tuple] = []
        at, last, run, before = 0, None, None, 0
        for doc_id, position, count, check in zip(row["doc_ids"], row["positions"], row["counts"], row["checks"], strict=True):
            words_of = order[at : at + count]
            mine = words_of.tolist()
            at += count
            decoded = b"".join([raw[i] for i in mine])
            if xxhash.xxh64_intdigest(decoded) - (1 << 63) != check:
                raise ValueError(f"document {doc_id} does not decode to its text")
            ids = ",".join([text[i] for i in mine])
            n_tokens = int(size[words_of].sum())
            if position is None or last is None or position != last + 1:  # a run of positions begins
                run, before = position, 0
            out.append(
                (
                    doc_id,
                    n_tokens,
                    hashlib.sha256(ids.encode()).hexdigest(),
                    hashlib.sha256(decoded).hexdigest(),
                    _gathered(said, first[words_of], size[words_of]) if with_ids else None,
                    decoded.decode("utf-8") if with_text else None,
                    position,
                    run,
                    before,
                )
            )
            last, before = position, before + n_tokens
        kinds_ = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded", "position", "run", "before"]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], names)

    return lay_out


def _gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices values[first : first + size], one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int32)


_tokens: dict[int, list[bytes]] = {}


def _token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: bytes by id."""
    if len(ranks) not in _tokens:
        by_id = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            by_id[i] = b
        _tokens[len(ranks)] = by_id
    return _tokens[len(ranks)]


def bpe_encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, with_ids: bool = True, with_text: bool = False, position_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded``.

    ``ids`` (``with_ids``) are the token ids without special tokens, ``decoded``
    (``with_text``) the text the ids decode to; the digests are of the ids, decimal
    and comma-joined, and of the decoded bytes. Null and empty texts have no tokens. Ids
    may be null or repeated. Other columns are not read. Empty input, empty result.

    With ``position_col`` (a row's number in some order) the result also has ``position``, ``run`` and ``before``:
    documents whose positions follow each other in a block are a run, named by its first position, and ``before`` is
    the number of tokens of the run before the document. Rows read in their order make a run a block or file split."""
    spark: SparkSession = docs.sparkSession
    path = run_dir(spark, "bpe")
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))  # bounded by the vocabulary
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(position_col) if position_col else F.lit(None)).cast("long").alias("position"))
    blocks = written_bucketed(rows.mapInArrow(_blocks(block_bytes), _BLOCKS), f"{path}/blocks", "block")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = blocks.select("block", "words", "sizes").mapInArrow(_explode, "block long, place int, word binary")
    ids = words.repartition(n, "word").sortWithinPartitions("word").mapInArrow(_encode(ranks), "block long, places binary, counts binary, ids binary")
    asked = blocks.select("block", "doc_ids", "positions", "counts", "checks", "order")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string, position long, run long, before long"
    out = asked.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(giving_back(_reassemble(ranks, with_ids, with_text)), schema)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []), *(["decoded"] if with_text else []), *(["position", "run", "before"] if position_col else []))
