"""BPE against the tiktoken library."""

import base64
import hashlib
import random
import tracemalloc

import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from storelake.llm import bpe
from storelake.llm.common import buffers, plain

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(P.PATTERN)


def _pre_tokens(texts):
    data, offsets = buffers(plain(pa.array(texts, pa.string())))
    starts, ends, ranges = bpe.pre_tokens(data, offsets)
    raw = data.tobytes()
    return [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(ranges[:-1], ranges[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t'strevmldSA1٣é中​ 　!?.😀-", max_size=30), min_size=1, max_size=5))
def test_pre_tokens_match_the_pattern(texts):
    assert _pre_tokens(texts) == [PATTERN.findall(t) for t in texts]


def test_merges_match_the_library():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß中 🙂zqx") for _ in range(rng.randint(1, 90))) for _ in range(800)] + ["a" * 5000, "ab" * 700 + "é" * 300]
    for w in words:
        raw = w.encode()
        assert bpe.merge(raw, RANKS) == bpe._merge_long(raw, RANKS) == LIBRARY._core_bpe.encode_single_piece(raw)


@pytest.mark.parametrize("block_bytes", [100, bpe.BLOCK_BYTES])
def test_encode_decode(edge_docs, block_bytes):
    got = bpe.bpe_encode_decode(edge_docs, PATH, block_bytes=block_bytes, with_text=True).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), ids, r.text or ""))
    order = lambda x: (x[0] is None, x[0], x[5])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_empty(no_docs):
    assert bpe.bpe_encode_decode(no_docs, PATH).count() == 0


def test_ranks_file():
    first = open(PATH, "rb").readline().split()
    assert RANKS[base64.b64decode(first[0])] == int(first[1])


def test_a_block_takes_a_few_bytes_a_word():
    block = bpe._Block()
    rng = random.Random(5)
    for i in range(40):
        data, offsets = buffers(plain(pa.array([" ".join(f"w{rng.randint(0, 300)}" for _ in range(20_000))])))
        block.add([i], [None], data, offsets)
    tracemalloc.start()
    block.row(0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * sum(block.counts)


def test_positions_give_runs(spark):
    rows = [(7, 10, "a b c"), (8, 11, ""), (9, 12, "d"), (5, 20, "e f"), (None, 21, None), (6, None, "g"), (4, 22, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, place long, text string").coalesce(1)
    got = bpe.bpe_encode_decode(docs, PATH, position_col="place").collect()
    assert {r.position: (r.doc_id, r.run, r.before) for r in got} == {10: (7, 10, 0), 11: (8, 10, 3), 12: (9, 10, 3), 20: (5, 20, 0), 21: (None, 20, 2), None: (6, None, 0), 22: (4, 22, 0)}
