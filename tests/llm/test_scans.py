"""Secret, licence and span scans against brute force."""

import hashlib
import random
import re
import string

import numpy as np
import pytest

from storelake.llm import licenses as lic
from storelake.llm import secret_scan as sec
from storelake.llm.spans import sentences, span_dedup, word_runs

BITS = ["token: ", 'api_key = "', "Password=", "secret:", "AKIA", "0123456789abcdef", "ABCDEFGH12345678", " ", "'", "xyz.", "é", "==", "PASSWD : '", "\n"]


def _expected(text):
    letters = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    keys = "|".join([letters("password"), letters("passwd"), letters("secret"), letters("token"), letters("api") + "_?" + letters("key")])
    assign = re.compile(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_spans():
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))
        assert sec.base_spans(text) == _expected(text)


def test_battery_tells_random_from_text():
    rng = random.Random(5)
    for size in (16, 36, 64):  # p-values of random strings are close to uniform
        merged = next(m for _, a, _, m in sec._TABLES if len(a) == size)
        fair = np.array([sec.battery(np.array([rng.randrange(size) for _ in range(60)]), merged) for _ in range(2000)])
        assert 0.02 < np.mean(fair < 0.05) < 0.1 and np.mean(fair < 0.001) < 0.01
    assert sec.candidate("thequickbrownfox1jumpsoverthelazydogandrunsawayintothewoods")[1] < 1e-2
    assert sec.candidate("a1" * 40)[1] < 1e-12
    assert sec.candidate("averylongwordwithoutanydigits") is None


def test_secret_query(spark, edge_docs, no_docs):
    rng = random.Random(6)
    b64 = string.ascii_letters + string.digits + "+/"
    hidden = ["".join(rng.choice(b64) for _ in range(48)) for _ in range(60)]
    dull = [f"section{i:04d}ofthelongreport{i % 7}" for i in range(300)] + ["ab12" * 12 for _ in range(60)] + ["Aa1Aa1Aa1" * 5 for _ in range(60)]
    docs = [(i, f"some text {t} and more\ntoken = abcdefgh{i}") for i, t in enumerate(hidden + dull)]
    got = {r.doc_id: r for r in sec.secret_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    caught = [("random:10:58" in got[i].spans) for i in range(60)]
    false = [("random:" in got[i].spans) for i in range(60, len(docs))]
    assert np.mean(caught) > 0.9 and np.mean(false) < 0.02
    for i, t in docs:
        own = ",".join(f"{sec.KINDS[k]}:{a}:{b}" for a, k, b in _expected(t))
        assert got[i].base_sha256 == hashlib.sha256(own.encode()).hexdigest() and got[i].n_assign == 1
        assert set(own.split(",")) <= set(got[i].spans.split(","))
    assert sec.secret_scan(edge_docs).count() == edge_docs.count() and sec.secret_scan(no_docs).count() == 0


# --------------------------------------------------------------------------- licences


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))


def test_matching_statistics():
    rng = random.Random(7)
    for _ in range(200):
        seqs = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        auto = lic.SuffixAutomaton(seqs)
        query = [rng.randrange(5) for _ in range(25)]
        runs = {tuple(s[a:b]): set() for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        for n, s in enumerate(seqs):
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    runs[tuple(s[a:b])].add((n, b))
        for i, (state, size) in enumerate(auto.matches(query)):
            want = max((k for k in range(1, i + 2) if tuple(query[i + 1 - k : i + 1]) in runs), default=0)
            assert size == want
            if size:
                got = {(n, e) for n, ends in auto.ends[state].items() for e in ends}
                assert got == runs[tuple(query[i + 1 - size : i + 1])]


def test_license_base(spark):
    rng = random.Random(8)
    bits = ["CC BY", "cc-by", "General Public License", "all rights", "reserved", "All Rights\nReserved.", "the", "of", "ccby", "license", "Café", "public", "x"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    got = {r.doc_id: r for r in lic.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        w = _words(t)
        places = [(i, label) for phrase, label in lic.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_templates(spark, edge_docs, no_docs):
    mit = lic.TEMPLATES["mit"][1]
    words = mit.split()
    docs = [
        (0, f"Intro words here. {mit.title()}. Other words."),
        (1, " ".join([*words[:12], "oddly", *words[12:20], "and", "strangely", *words[20:]])),  # gaps
        (2, " ".join(words[:8])),  # too little of it
        (3, "free software of the world without restriction to any person"),
        (4, f"{mit} {mit}"),
    ]
    got = {r.doc_id: r for r in lic.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].labels == "mit" and got[0].score == 1.0
    assert [(s.label, s.start, s.end) for s in got[0].spans] == [("mit", 3, 3 + len(words))]
    assert got[1].labels == "mit" and [s.end - s.start for s in got[1].spans] == [len(words) + 3]
    assert got[2].labels == got[3].labels == "" and got[2].score == 0.0
    assert len(got[4].spans) == 2
    assert lic.license_scan(edge_docs).count() == edge_docs.count() and lic.license_scan(no_docs).count() == 0


# --------------------------------------------------------------------------- spans


def _brute(docs):
    """(removed sentences by document, holders) by dictionaries of the spans' texts."""
    places = {}
    units = {d: sentences(t or "") for d, t in docs}
    for d in sorted(units):
        u = units[d]
        for i in range(len(u)):
            n = [len(w) for _, _, w in u[i:]]
            j = next((k for k in range(3, len(n) + 1) if sum(n[:k]) >= 8), None)
            if j:
                key = tuple(" ".join(w).lower() for _, _, w in u[i : i + j])
                places.setdefault(key, []).append((d, i, i + j))
    gone, held = {}, {}
    for at in places.values():
        for d, i, j in at[1:]:
            gone.setdefault(d, set()).update(range(i, j))
            held.setdefault(d, set()).add(at[0][0])
    return units, gone, held


def test_span_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))).capitalize() + rng.choice([".", "!", "?\n"]) for _ in range(60)]
    passages = [" ".join(rng.sample(pool, 5)) for _ in range(6)]
    docs = []
    for d in range(80):
        own = [f"{'z' * rng.randint(1, 9)}{d} {rng.random()} said so {rng.random()}." for _ in range(rng.randint(0, 6))]
        docs.append((d, " ".join([*own, *(rng.choice(passages) for _ in range(rng.randint(0, 2))), *own[:1]])))
    got = {r.doc_id: r for r in span_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    units, gone, held = _brute(docs)
    assert any(gone.values())
    for d, t in docs:
        left = "".join(t[a:b] for k, (a, b, _) in enumerate(units[d]) if k not in gone.get(d, ()))
        assert (got[d].clean_text, got[d].n_removed) == (left, len(gone.get(d, ())))
        assert got[d].copied_from == sorted(held.get(d, ()))


def test_long_passages_are_always_caught(spark):
    rng = random.Random(10)
    docs, passage = [], " ".join(f"w{rng.randrange(900)}" for _ in range(51)) + "."  # one sentence of 51 words
    for d in range(20):
        own = " ".join(f"v{d}x{rng.randrange(900)}" for _ in range(70)) + "."
        docs.append((d, f"{own}\n{passage}\n{own[::-1]}"))
    got = span_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all((passage in r.clean_text) == (r.doc_id == 0) for r in got)


@pytest.mark.parametrize("text", ["", "One. Two! Three?\nFour", "no end", "a" * 10, "w " * 70, "\n\n x.y z. "])
def test_sentences_cover_the_text(text):
    cut = sentences(text)
    assert "".join(text[a:b] for a, b, _ in cut) == text
    assert [x for _, _, w in cut for x in w] == text.split()


def test_span_edges(edge_docs, no_docs):
    got = span_dedup(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[10].n_removed == 3 and by[10].copied_from == [1] and by[1].n_removed == 0
    assert by[3].clean_text == "" and None in by
    assert span_dedup(no_docs).count() == 0


def _repeats(texts, n=51):
    """Windows of ``n`` words that stand in two documents."""
    seen = {}
    for d, t in enumerate(texts):
        w = t.lower().split()
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(d)
    return [k for k, at in seen.items() if len(at) > 1]


def test_passages_are_caught_wherever_they_begin(spark):
    """51 words inside a sentence, at any offset, without end marks, wrapped at other line ends, and in a script without spaces."""
    rng = random.Random(11)
    said = [f"w{rng.randrange(900)}" for _ in range(51)]
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(60))
    texts, own = [], []
    for d in range(24):
        before, after = ([f"{c}{d}x{rng.randrange(900)}" for _ in range(5 + 7 * d)] for c in "uv")
        inner = "".join((" " if rng.random() < 0.8 else "\n") + (w.upper() if rng.random() < 0.2 else w) for w in said).strip()
        other = "".join(chr(0x3400 + 40 * d + rng.randrange(40)) for _ in range(d % 10 + 30))  # too short to count
        texts.append(f"{' '.join(before)} {inner} {' '.join(after)}\n{other}{cjk}{other}")
        own.append(f"{' '.join(before)} {' '.join(after)}\n{other}{other}")
    assert _repeats(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in span_dedup(docs, block_bytes=3000).collect()}
    assert got[0].clean_text == texts[0] and got[0].removed_chars == 0
    for d in range(1, 24):
        assert got[d].clean_text == own[d] and got[d].copied_from == [0]
        assert got[d].removed_chars == len(texts[d]) - len(own[d])


def test_no_long_window_stays_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = span_dedup(docs).orderBy("doc_id").collect()
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    keep = set(_repeats(texts))
    assert len(got) == len(texts) and keep
    assert not keep & set(_repeats([r.clean_text for r in got]))


def test_first_place_of_a_text_that_repeats_itself_stays(spark):
    docs = spark.createDataFrame([(1, "so " * 200)], "doc_id long, text string")
    assert word_runs(["so " * 200])[1].size == 200
    assert span_dedup(docs).first().removed_chars < 600


def test_secrets_in_names_paths_and_other_alphabets(spark):
    """NAME=value, keys in paths and behind prefixes, upper-case and signed alphabets and short strings reach the battery."""
    rng = random.Random(12)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n - 2)) + rng.choice(string.digits) + rng.choice([c for c in chars if c.isalpha()])
    mixed = string.ascii_letters + string.digits
    makers = {
        "env": lambda: ("AWS_KEY=", draw(mixed + "+/", 40), ""),
        "path": lambda: ("/srv/my-files_of/", draw(mixed, 40), "/list-all"),
        "prefix": lambda: ("xoxb-", draw(mixed, 32), ""),
        "upper": lambda: ("", draw(string.ascii_uppercase + string.digits, 32), ""),
        "uuid": lambda: ("", "-".join(draw("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), ""),
        "short": lambda: ("", draw(mixed, 16), ""),
    }
    hidden = [(kind, *make()) for kind, make in makers.items() for _ in range(40)]
    dull = [f"section{i:04d}ofthelongreport{i % 7}" for i in range(300)] + [f"PART{i:04d}OFTHELONGREPORT{i % 7}" for i in range(300)]
    rows = [(i, f"some text {a}{b}{c} and more") for i, (_, a, b, c) in enumerate(hidden)] + [(1000 + i, f"some text {t} and more") for i, t in enumerate(dull)]
    got = {r.doc_id: r.spans for r in sec.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def caught(i):
        start = 10 + len(hidden[i][1])
        stop = start + len(hidden[i][2])
        spans = [x.split(":") for x in got[i].split(",") if x.startswith("random:")]
        return any(int(a) <= start and stop <= int(b) for _, a, b in spans)

    for kind in makers:
        mine = [caught(i) for i, x in enumerate(hidden) if x[0] == kind]
        assert np.mean(mine) > 0.85, (kind, np.mean(mine))
    assert np.mean(["random:" in got[1000 + i] for i in range(len(dull))]) < 0.02
