"""Document operators against plain versions, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tracewright.llm import kernels as K
from tracewright.llm import merkle
from tracewright.llm.jaccard_join import Trie, jaccard_join, near_groups
from tracewright.llm.merkle import differing, document_fingerprints, fingerprint, leaves, likeness
from tracewright.llm.mixing import mix_sources
from tracewright.llm.packing import CAPACITY, best_fit_packing, encoder, plan
from tracewright.llm.spread import components
from tracewright.llm.suffix_dedup import RunIndex, _read_chunk, suffix_dedup
from tracewright.llm.token_count import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int, data string"
WORDS = "alpha beta gamma delta éclair zwölf omega sigma tau pi rho psi chi eta zeta kappa lambda mu nu xi".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus():
    """Texts with exact and near copies, shared passages, empty, null and long ones, a repeated row, a null id."""
    rng = random.Random(7)
    base = [prose(rng, rng.choice([3, 4, 5, 30, 200])) for _ in range(40)]
    texts = list(base)
    texts += [base[4]] * 6 + [base[7] + " tail", "head " + base[7], None, "", "   \n", "x" * 3000, "日本語テキスト " * 40, "日本語テキスト " * 40]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(12)]
    near = prose(rng, 120).split()
    for i in range(15):  # a chain of near copies, each a few words from the last
        near = list(near)
        near[(7 * i) % len(near)] = f"word{i}"
        texts.append(" ".join(near))
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4] if i % 3 else "hot", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base[4], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in corpus()], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def last(i):
    return K.NULL_ID if i is None else i


def test_suffix_dedup_equals_brute_force(docs):
    rows = [(last(i), (t or "").encode()) for i, t, *_ in corpus()]
    first = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup(docs, 50, carry=("lang",)).collect()
    assert sorted((last(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
        assert len(r.text.encode()) >= len(r.kept)  # characters stay whole


def test_segments_do_not_depend_on_the_order_of_rows():
    """A chunk's rows may come in another order each time it is read, and answers go by the content of segments."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(9_000)) for _ in range(12)]  # over several blocks

    def contents(order):
        table = pa.table({"doc_id": pa.array(order, pa.int64()), "text": [texts[i] for i in order]})
        docs, raw, _, doc, a, b, _, _, _ = _read_chunk(table, 50)
        return {(int(docs[d]), raw[s:e].tobytes()) for d, s, e in zip(doc, a, b, strict=True)}

    assert contents(range(12)) == contents(range(11, -1, -1))


def test_run_index_matching_statistics():
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab") for _ in range(70)) for _ in range(8)]
    texts = [p[: rng.randint(50, 70)] for p in parts] + [parts[0][5:60], parts[3], "a" * 70, "a" * 55]
    raw, size = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts])
    least = np.array([9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 11, 10])
    got, offsets = RunIndex(raw, size, least, 50).stream()
    for k, t in enumerate(texts):
        want = [min(int(d) for u, d in zip(texts, least, strict=True) if t[p : p + 50] in u) for p in range(len(t) - 49)]
        assert got[offsets[k] : offsets[k + 1]].tolist() == want


def test_runs_are_few_where_text_repeats():
    rng = random.Random(6)
    base = prose(rng, 400).encode()
    texts = [base]
    for _ in range(100):  # copies that differ in a byte here and there
        t = bytearray(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = rng.choice(b"xyz")
        texts.append(bytes(t))
    index = RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), np.arange(101), 50)
    assert len(index.heads) < 0.06 * index.windows.sum() and len(index.heads) < 0.6 * index.groups
    first = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], d)
    assert index.stream()[0].tolist() == [first[t[p : p + 50]] for t in texts for p in range(len(t) - 49)]
    assert index.left(np.array([0]), np.array([7])).tolist() == [-1]


@pytest.mark.parametrize("hot", [1 << 14, 20, 0])
def test_suffix_dedup_of_long_texts(spark, hot):
    """Texts of several hashing blocks, with passages across their edges, a hot anchor with many different surroundings, and near copies."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**5)}"
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(6):
        text = " ".join(word() for _ in range(15_000))
        for at in (K.BLOCK - 100, K.BLOCK - 30, 2 * K.BLOCK - 5, len(text) - 1):
            text = text[:at] + passage + text[at:]
        rows.append((i, text))
    rows += [(10, rows[2][1][:50_000] + "!" + rows[2][1][50_000:]), (11, "a" * 70_000), (12, "a" * 80_000)]
    rows += [(20 + i, f"{word()} {word()} the quick brown fox jumps over the lazy dog {word()} {word()}") for i in range(150)]
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    want = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        want.append((i, int(gone.sum()), bytes(np.frombuffer(t.encode(), np.uint8)[~gone]).decode()))
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), outputs=("text",), hot=hot)
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got.collect()) == want


@pytest.mark.parametrize("parts", [3, 200])
def test_suffix_dedup_where_nothing_differs(spark, parts):
    text = prose(random.Random(5), 60)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = suffix_dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), 50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    size = len(text.encode())
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got) == [(1, 0, text), (2, size, "")]


def sets_of(rows):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[last(i)] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(sets, linked=None):
    if linked is None:
        linked = [(a, b) for a, b in combinations(sorted(sets), 2) if (both := len(sets[a] & sets[b])) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)]
    root = {i: i for i in {*sets, *(x for pair in linked for x in pair)}}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in root}


def test_jaccard_join_equals_brute_force(docs):
    sets = sets_of(corpus())
    want = brute_components(sets)
    got = jaccard_join(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        i = last(r.doc_id)
        assert (r.n_shingles, last(r.component_id)) == (len(sets[i]), want[i])


def test_jaccard_join_keeps_different_texts_of_one_id_apart(spark):
    rng = random.Random(11)
    rows, want = [], []
    for k in range(8):  # two texts under one id (null at last), each with a shorter near copy under an id of its own
        i = 10 * k if k < 7 else None
        for near in (10 * k + 1, 10 * k + 2):
            words = [f"w{rng.randrange(10**9)}" for _ in range(60)]
            rows += [(i, " ".join(words)), (near, " ".join(words[:-2]))]
            least = near if i is None else i
            want += [(i, 56, least), (near, 54, least)]
    rows += [(3, "some words that nobody else has at all"), (None, "other words that nobody else has at all"), (None, "")]
    want += [(3, 4, 3), (None, 4, None), (None, 0, None)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_trie_probe_equals_sets():
    rng = np.random.default_rng(5)
    stored = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(60)]
    stored += [np.arange(0, 900, dtype=np.uint64), np.arange(0, 700, dtype=np.uint64)]  # runs of several nodes
    stored = list({s.tobytes(): s for s in stored}.values())
    more = rng.integers(0, 4, len(stored))  # shingles that are not stored
    sizes = np.array([len(s) for s in stored]) + more
    trie = Trie(stored, sizes)
    queries = [*stored, np.arange(5, 22, dtype=np.uint64), np.array([10**6], np.uint64)]
    asked = np.array([*sizes, 18, 1])
    want = {(q, k) for q in range(len(queries)) for k, s in enumerate(stored) if 100 * (o := len(np.intersect1d(s, queries[q]))) >= 35 * (asked[q] + sizes[k] - o)}
    got = list(zip(*(x.tolist() for x in trie.probe(queries, asked, 35, 100)), strict=True))
    assert sorted(got) == sorted(want) and len(want) > len(stored)
    group, own = rng.integers(0, 3, len(stored)), rng.integers(0, 3, len(queries))
    got = list(zip(*(x.tolist() for x in trie.probe(queries, asked, 35, 100, group[trie.order], own)), strict=True))
    assert sorted(got) == sorted((q, k) for q, k in want if own[q] != group[k])


@pytest.mark.parametrize("most", [1 << 19, 4000])
def test_jaccard_join_of_a_large_near_group(spark, most):
    """500 copies of one text, edited so much that many don't link, some only through others; with one trie and many."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5])):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z"])
        rows.append((i, " ".join(words[rng.choice([0, 0, 5]) :])))
    want = brute_components(sets_of(rows))
    assert 20 < len(set(want.values())) < 400
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), most=most)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(4)
    links = [(a, max(0, a - rng.choice([1, 1, 7]))) for a in range(300) if a % 50] + [(5000, 5000), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    want = brute_components({a: {b} for a, b in links}, linked=links)
    for most in (10**6, 0):
        assert {r.node: r.component for r in components(df, most).collect()} == want


def test_packing_layout_and_ids(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = best_fit_packing(docs, path, ids=True).collect()
    rows = corpus()
    texts = [t or "" for _, t, *_ in rows]
    whole = [[*e.ids, 1] for e in encoder(path).library.encode_batch(texts, add_special_tokens=False)]
    want = Counter((last(r[0]), k, at, zlib.crc32(np.array(w[at : at + CAPACITY], "<u4").tobytes())) for r, w in zip(rows, whole, strict=True) for k, at in enumerate(range(0, len(w), CAPACITY)))
    assert Counter((last(r.doc_id), r.piece, r.start, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        assert len(r.ids) == r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert len(by) <= -(-sum(map(len, whole)) // CAPACITY) + 1


def test_long_documents_are_cut(spark):
    """Documents over the capacity: of just as many tokens, one more, several pieces, and one without spaces."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = encoder(path).library
    word = lambda n: " ".join(["the"] * n)
    assert len(library.encode(word(10), add_special_tokens=False).ids) == 10
    rng = random.Random(13)
    texts = [word(CAPACITY - 1), word(CAPACITY), word(CAPACITY + 1), word(3 * CAPACITY - 1), prose(rng, 9000), "".join(rng.choice("abcdef") for _ in range(30_000)), word(5)]
    got = best_fit_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), path).collect()
    want = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want += [(i, k, at, len(ids[at : at + CAPACITY]), zlib.crc32(np.array(ids[at : at + CAPACITY], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), CAPACITY))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want and len(want) > 12


def test_token_counts_of_long_texts_and_full_caches(spark, monkeypatch):
    import sentencepiece

    from tracewright.llm import token_count

    monkeypatch.setattr(token_count, "REMEMBERED", 400)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    lengths = token_count.Lengths(path, {"the": 1})
    rng = random.Random(14)
    for _ in range(6):  # more words than are remembered, and texts over half of that
        for n in (50, 150, 250, 900, 3000):
            text = " ".join(rng.choice(["the", f"w{rng.randrange(2000)}", "word,", "x\ny"]) for _ in range(n))
            assert lengths.count(text) == len(library.encode(text))
    assert len(lengths.cache) <= 400 + 2000


def test_plan_packs_everything_tightly():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 5000).astype(int), 1, 4096), minlength=4097)
    bins = plan(counts, 4096)
    used = np.zeros(4097, int)
    for pattern, times in bins:
        assert sum(pattern) <= 4096
        for n in pattern:
            used[n] += times
    assert (used == counts).all()
    assert sum(t for _, t in bins) <= -(-int((counts * np.arange(4097)).sum()) // 4096) * 1.02 + 1


@pytest.mark.parametrize("text", ["it's Don't 've", "ΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "é x ½ ²", "日本語 テスト…", "a" * 500, "Straße!! naïve... und*** a|b"])
def test_word_ids_equal_the_library(text):
    encode = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encode(text).tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_token_counts_equal_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "")), len(library.encode(r[1] or "")) > 100) for r in corpus())
    assert Counter(tuple(r) for r in token_counts(docs, path, limit=100, frequent=8).collect()) == want


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "a\nb\n\nc", "\n", "\na", "a \n b", "x▁y", "<s> </s>", "tab\tx", "日本 語\n語"])
def test_pre_tokens_add_up(text):
    from tracewright.llm.token_count import Lengths

    lengths = Lengths(public_tokenizers.path("piece_bpe_32k.model"), {})
    assert lengths.count(text) == len(lengths.library.encode(text))


def test_fingerprints(docs):
    rows = sorted(((last(i), t or "") for i, t, *_ in corpus()))
    got = {}
    for r in document_fingerprints(docs, each=4000).collect():
        got.setdefault(last(r.doc_id), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert any(r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == fingerprint(t) and r.near_next == likeness(fingerprint(t), fingerprint(after)) and r.near_edited == likeness(fingerprint(t), fingerprint(edited)) for r in got[i])


def test_lines_of_edited_texts_are_not_digested_again(monkeypatch):
    rng = random.Random(4)
    texts = ["\n".join(prose(rng, 20) for _ in range(30)) for _ in range(20)]
    cut, own = [], merkle.leaves
    monkeypatch.setattr(merkle, "leaves", lambda line: cut.append(line) or own(line))
    out = merkle._compare(pa.table({"tail": [False] * 20 + [True], "doc_id": [*range(20), 0], "text": [*texts, texts[0]]}))
    assert len(out) == 20
    assert len(cut) <= 20 * 30 + 2 * 20  # each line, and the two of an edited text that are cut through


def test_likeness_and_edit_places():
    rng = random.Random(2)
    text = "\n".join(prose(rng, 60) for _ in range(8))
    other = "\n".join(prose(rng, 60) for _ in range(8))
    edited = text[:1000] + "EDIT" + text[1004:]
    assert likeness(fingerprint(text), fingerprint(text)) == 1.0
    assert likeness(fingerprint(text), fingerprint(other)) < 0.05
    assert 0.8 < likeness(fingerprint(text), fingerprint(edited)) < 1.0
    for a, b in (("", "\n"), ("\n", "\n\n"), ("one line\nand another", "and another\none line"), ("a", "")):
        assert likeness(fingerprint(a), fingerprint(b)) < 1.0 == likeness(fingerprint(b), fingerprint(b))
    spans = differing(fingerprint(text), fingerprint(edited))
    assert any(a <= 1000 < b for a, b in spans) and sum(b - a for a, b in spans) < 600


def plain_tree(text):
    """Leaves, paragraphs and sections of a text as plain strings, by the same cuts."""
    sections = [[]]
    for line in text.split("\n"):
        own = leaves(line)
        assert "".join(own) == line
        sections[-1].append(own)
        if not line.strip() or int(hashlib.blake2b(own[-1].encode(), digest_size=6).hexdigest()[-1], 16) == 0:
            sections.append([])
    return sections


def test_likeness_equals_a_comparison_of_whole_strings():
    rng = random.Random(8)
    lines = [prose(rng, rng.choice([0, 3, 30, 90])) for _ in range(300)]
    for _ in range(60):
        a = [rng.choice(lines) for _ in range(rng.randint(1, 60))]
        one, two = "\n".join(a), "\n".join(x if rng.random() < 0.8 else rng.choice(lines) for x in a)
        if one == two:
            continue
        shared = 0
        left, right = ([tuple(map(tuple, s)) for s in plain_tree(t)] for t in (one, two))
        for size in (lambda s: sum(len(x) for p in s for x in p), lambda p: sum(map(len, p)), len):
            both = Counter(left) & Counter(right)
            shared += sum(size(n) * k for n, k in both.items())
            left, right = ([y for x in (Counter(side) - both).elements() for y in x] for side in (left, right))
        total = len(one) - one.count("\n") + len(two) - two.count("\n") + 2
        assert abs(likeness(fingerprint(one), fingerprint(two)) - 2 * shared / total) < 1e-12


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, t, _, source, *_ in rows:
        totals[source] += size(t)
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + ([None] if None in totals else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ones, left = {}, set(names), 1.5 * sum(totals.values())
    while True:
        unit = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if weight[s] * unit >= 2 * totals[s]}
        if not full:
            return totals, target | {s: weight[s] * unit for s in open_ones}
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        open_ones -= full
        if not open_ones:
            return totals, target


def test_mix_targets_and_takings(docs):
    rows = corpus()
    totals, target = brute_mix(rows)
    got = mix_sources(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(3)).collect()))
    taken, longest = Counter(), Counter()
    source = {last(r[0]): r[3] for r in rows}
    for r in got:
        s = source[last(r.doc_id)]
        assert r.source_size == totals[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert len(got) == len(rows)
    for s in totals:
        assert abs(taken[s] - target[s]) <= 2 * longest[s]


@pytest.mark.parametrize("run", [
    lambda d: suffix_dedup(d), lambda d: jaccard_join(d), lambda d: mix_sources(d), lambda d: document_fingerprints(d),
    lambda d: best_fit_packing(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
])
def test_empty_tables_give_no_rows(empty, run):
    assert run(empty).count() == 0


def test_span_hashes_across_blocks():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 3 * K.BLOCK).astype(np.uint8)
    start = np.array([0, 5, K.BLOCK - 3, K.BLOCK + 7, 2 * K.BLOCK - 1])
    end = np.array([4, 2 * K.BLOCK + 9, K.BLOCK + 5, K.BLOCK + 9, 3 * K.BLOCK])
    twice = np.concatenate([rng.integers(0, 256, 777).astype(np.uint8), raw])
    assert (K.span_hashes(raw, start, end) == K.span_hashes(twice, start + 777, end + 777)).all()
