"""Chats, vectors, classifiers and the pipeline."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from tracewright.llm import spread, stages, topk_search
from tracewright.llm.chat_format import END, START, format_chats, read_chats
from tracewright.llm import kernels as K
from tracewright.llm.quality import BEYOND, FINE, LEAST, LIMIT, ROUNDS, STEPS, SURE, CoTrained, Logistic, Pool, page_view, quality, text_view
from tracewright.llm.topk_search import top_k
from tracewright.llm.mixing import mix_sources
from tracewright.llm.packing import encoder
from tracewright.llm.toxicity import ALPHA, BETA, L1, L2, SEEN, features, fit, toxicity

TURNS = [
    (1, 0, "user", "hi <|im_end|> there"), (1, 1, "assistant", "a <|im_start|>b"), (1, 2, "assistant", "<\\|x <\\\\|"), (1, 3, "user", None),
    (2, 0, None, ""), (2, None, "assistant", "line\nfeed<|im_sep|>"), (3, 5, "we\nird <|role\\n", "|tail"), (3, 5, "we\nird <|role\\n", "|tail"), (None, 0, "assistant", "<"), (None, 1, "assistant", "|>"),
]


def test_chats_round_trip(spark):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = format_chats(turns)
    got = {r.conv_id: r for r in read_chats(formatted, "formatted").collect()}
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in {t[0] for t in TURNS}:
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == conv), key=key)]
        r = got[conv]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss_text == "".join(text for role, text in want if role == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert r.formatted.count(START) == r.formatted.count(END) == blocks
    assert format_chats(turns.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    rows += [(150, rows[3][1]), (151, rows[3][1]), (152, None), (153, [1.0] * 7 + [None]), (154, [float("nan")] * 8), (155, [float("inf")] * 8), (None, [0.5] * 8), (156, [1.0] * 3), (157, []), (100, rows[100][1])]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted(tuple(r) for r in top_k(vectors, vectors.where("vec_id % 50 = 0"), 10).collect())
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in (0, 50, 100, 150):
        mine = dict(good)[q]
        best = sorted(((-int(mine @ v), i) for i, v in good if i != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    few = vectors.where("vec_id < 3")
    assert top_k(few, few.where("vec_id = 0"), 10).count() == 2
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def _vectors(n, width, copies=1):
    x = np.repeat(np.random.default_rng(5).integers(-1000, 1000, (n // copies, width)), copies, axis=0)
    return x.astype(float), pa.RecordBatch.from_pydict({"vec_id": list(range(n)), "v": x.tolist()})


def test_top_k_tasks_hold_no_whole_matrix_of_scores():
    """4,000 queries by 2,000 rows are 64 MB of scores, whole."""
    q, batch = _vectors(4000, 16)
    shared, cutoffs = SimpleNamespace(value=(np.arange(4000), q)), SimpleNamespace(value=np.full(4000, 6e6))
    for phase in (topk_search._phase_one(shared, 3), topk_search._phase_two(shared, cutoffs, 3)):
        tracemalloc.start()
        found = list(phase([batch.slice(0, 2000), batch.slice(2000)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 1
        assert peak < 60e6


def test_top_k_first_phase_finds_k_among_equal_vectors():
    q, batch = _vectors(600, 8, copies=100)
    found = list(topk_search._phase_one(SimpleNamespace(value=(np.arange(600), q)), 3)([batch]))[0]
    assert np.bincount(found.column("query_id").to_numpy(), minlength=600).min() == 3


def test_top_k_in_rounds_blocks_and_two_widths(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROUND", 10_000)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=5 if i % 3 else 70)]) for i in range(900)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_k(vectors, vectors.where("vec_id % 2 = 0"), 3).collect())
    want = []
    for width in (5, 70):
        ids = np.array([i for i, v in rows if len(v) == width])
        x = np.floor(1024 * np.array([v for _, v in rows if len(v) == width])).astype(int)
        for i in np.flatnonzero(ids % 2 == 0):
            best = sorted((-int(s), int(j)) for s, j in zip(x @ x[i], ids, strict=True) if j != ids[i])[:3]
            want += [(int(ids[i]), r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_the_cutoff_saves_work():
    rng = np.random.default_rng(9)
    x = np.floor(1024 * (v := rng.normal(size=(4000, 64))) / np.linalg.norm(v, axis=1, keepdims=True))
    q = x[:100]
    full = q @ x.T
    tau = np.sort(full, axis=1)[:, -10]
    at, to, s, work = topk_search.resolve(q, x, tau)
    assert sorted(zip(at.tolist(), to.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(full >= tau[:, None]).tolist())) and (s == full[at, to]).all()
    assert work[-1] < 0.1 * full.size and sum(work) < 0.95 * full.size * len(work)  # no two vectors are alike here: the worst case for bounds
    centres = rng.normal(size=(40, 64))
    x = np.floor(1024 * (v := centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 64))) / np.linalg.norm(v, axis=1, keepdims=True))
    full = x[:100] @ x.T
    work = topk_search.resolve(x[:100], x, np.sort(full, axis=1)[:, -10])[3]
    assert work[-1] < 0.02 * full.size and sum(work) < 0.5 * full.size * len(work)


def labelled(seed=1, n=900):
    rng = random.Random(seed)
    syllables = ["ba", "ke", "lo", "mi", "tu", "ra", "ne", "so"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic, bad = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grubbo", "snark", "vilefu"]))
        if bad:
            words = [w.upper() + "!!" for w in words]
        text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(None, None, None, None, None), (n, "", None, "s1", 0), (n + 1, "x" * 200_000, "de", None, None), rows[3]]
    return rows, [*labels, (None, 1, 1), (5, None, None)]


@pytest.fixture(scope="module")
def sample(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([(*r, 0.0, 1, False) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, label int, keep boolean")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, (q, t)) for i, q, t in labels if q is not None and i is not None)


def test_toxicity_on_held_out_documents(sample):
    docs, labels, truth = sample
    got = toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_on_labelled_documents(sample):
    docs, labels, truth = sample
    got = quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert np.mean([r.keep == (truth[r.doc_id][0] == 1) for r in got if r.doc_id in truth]) > 0.97
    assert quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}


def plain_co_training(text, page, y, held, free_text, free_page):
    """Co-training again, with labels kept for each document and plain loops."""
    known, prior = ~held, y[~held].mean()
    views, free = (text, page), (free_text, free_page)
    models = [Logistic(x[known], y[known]) for x in views]
    labels = [[None] * len(free_text) for _ in views]
    most = int(SURE * len(free_text))
    for _ in range(ROUNDS):
        fresh = []
        for k in (0, 1):
            scores = [int(np.floor((v + LIMIT) * FINE)) for v in models[k].logit(free[k])]
            open_ones = sorted(scores[i] for i in range(len(scores)) if labels[1 - k][i] is None)
            low, high = round(most * (1 - prior)), round(most * prior)
            low = open_ones[min(low, len(open_ones)) - 1] if low and open_ones else -1
            high = open_ones[-min(high, len(open_ones))] if high and open_ones else 10**9
            real = models[k].logit(free[k])
            usual = np.log(prior / (1 - prior))
            down, up = min(-LEAST, usual - BEYOND), max(LEAST, usual + BEYOND)
            fresh.append([0 if s <= low and v <= down else 1 if s >= high and v >= up else None for s, v in zip(scores, real, strict=True)])
        for k in (0, 1):
            labels[1 - k] = [old if old is not None else new for old, new in zip(labels[1 - k], fresh[k], strict=True)]
        for _ in range(STEPS):
            for k in (0, 1):
                at = [i for i, v in enumerate(labels[k]) if v is not None]
                x = np.concatenate([views[k][known], free[k][at]])
                models[k].step(*models[k].sums(x, np.concatenate([y[known], [labels[k][i] for i in at]]), safe=True))
    both = np.stack([m.logit(x[held]) for m, x in zip(models, views, strict=True)], axis=1)
    calibrated = [Logistic(both[:, [k]], y[held], 0.1) for k in (0, 1)]
    joint = Logistic(np.stack([c.logit(both[:, [k]]) for k, c in enumerate(calibrated)], axis=1), y[held], 0.1)
    return lambda t, p: 1 / (1 + np.exp(-joint.logit(np.stack([c.logit(m.logit(x)[:, None]) for m, c, x in zip(models, calibrated, (t, p), strict=True)], axis=1))))


def test_quality_equals_plain_co_training(spark):
    """Every unlabelled document takes part, and scores are those of the plain version."""
    rows, labels = labelled(seed=4, n=700)
    rows = [r for r in rows if r[0] is not None and len(r[1]) < 100_000 and r[0] < 700]
    rows = list({r[0]: r for r in rows}.values())
    labels = [(i, q, t) for i, q, t in labels if i is not None and i % 3 == 0 and q is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    got = {r.doc_id: r.score for r in quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    table = pa.table({k: [r[i] if r[i] is not None else "" for r in rows] for i, k in ((1, "text"), (2, "lang"), (3, "source"))} | {"n_chars": pa.array([r[4] for r in rows], pa.int64())})
    text, page = (x.astype(np.float16).astype(float) for x in (text_view(table.column("text")), page_view(table.column("source"), table.column("lang"), table.column("n_chars").combine_chunks())))
    ids, truth = np.array([r[0] for r in rows]), {i: q for i, q, _ in labels}
    has = np.array([i in truth for i in ids])
    order = np.flatnonzero(has)[np.argsort(ids[has])]
    held = K.mix(ids[order].astype(np.uint64) + np.uint64(7)) % np.uint64(4) == 0
    score = plain_co_training(text[order], page[order], np.array([truth[i] for i in ids[order]]), held, text[~has], page[~has])
    assert np.allclose([got[i] for i in ids], score(text, page), atol=1e-6)


def test_a_view_that_learns_nothing_labels_nothing():
    """Metadata that say nothing must not spoil what the text says."""
    rng = np.random.default_rng(2)
    y = (rng.random(3000) < 0.85).astype(int)
    text = np.where(y, 1.0, -1.0)[:, None] + 0.3 * rng.normal(size=(3000, 4))
    page = np.eye(6)[rng.integers(0, 6, 3000)]
    model = CoTrained(text[:1000], page[:1000], y[:1000], np.arange(1000) % 4 == 0, Pool(text[1000:], page[1000:]))
    assert np.mean((model.score(text[1000:], page[1000:]) >= 0.5) == y[1000:]) > 0.99


def test_conflicting_labels_count_as_the_larger(spark):
    rows = [(i, ("fine words here " if i % 2 else "BAD!! ") * 20, "en", "s", 100) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q, 0) for i in range(60) for q in ((0, 1) if i % 2 else (0, 0))], "doc_id long, quality int, toxic int")
    assert {(r.doc_id % 2, r.keep) for r in quality(docs, labels).collect()} == {(0, False), (1, True)}


def test_views_see_their_own_columns_only():
    from tracewright.llm.quality import page_view, text_view

    t = text_view(pa.array(["One two. Three!", None, ""]))
    assert t.shape[0] == 3 and np.isfinite(t).all() and (t[1] == t[2]).all()
    p = page_view(pa.array(["a", None, ""]), pa.array(["en", "en", "de"]), pa.array([10, None, 5]))
    assert (p[1] != p[0]).any() and np.isfinite(p).all()


def plain_ftrl(examples, epochs):
    """FTRL-proximal with dictionaries and one coordinate at a time."""
    from collections import Counter, defaultdict
    from math import exp, sqrt

    seen = Counter(c for _, x in examples for c in x)
    z, n = defaultdict(float), defaultdict(float)
    zb = nb = bias = 0.0

    def weight(c):
        if abs(z[c]) <= L1:
            return 0.0
        return -(z[c] - (L1 if z[c] > 0 else -L1)) / ((BETA + sqrt(n[c])) / ALPHA + L2)

    for _ in range(epochs):
        for label, x in examples:
            x = [c for c in x if seen[c] >= SEEN]
            w = {c: weight(c) for c in x}
            g = 1 / (1 + exp(-max(-30, min(30, sum(w.values()) + bias)))) - label
            for c in x:
                z[c] += g - (sqrt(n[c] + g * g) - sqrt(n[c])) / ALPHA * w[c]
                n[c] += g * g
            zb += g - (sqrt(nb + g * g) - sqrt(nb)) / ALPHA * bias
            nb += g * g
            bias = -zb / ((BETA + sqrt(nb)) / ALPHA)
    return {c: weight(c) for c in seen if weight(c)}, bias


def test_ftrl_equals_a_plain_version():
    rows, labels = labelled(seed=3, n=250)
    truth = {i: t for i, _, t in labels if t is not None}
    rows = [r for r in rows if r[0] is not None and r[0] < 250][:250]
    x, doc = features(pa.array([r[1] for r in rows]))
    examples = [(truth[r[0]], sorted(set(x[doc == i].tolist()))) for i, r in enumerate(rows)]
    packed = [(label, spread.pack(np.diff(np.array(c), prepend=0).astype(np.uint32))) for label, c in examples]
    at, w, bias = fit(packed, 3)
    want, want_bias = plain_ftrl(examples, 3)
    assert len(want) > 10 and abs(bias - want_bias) < 1e-3
    got = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert all(abs(got.get(c, 0.0) - want.get(c, 0.0)) < 1e-2 for c in {*got, *want})
    word = features(pa.array(["one Two three"]))[0]
    assert len(word) == 3 + 2 + 1 and (features(pa.array(["ONE tWo THREE"]))[0] == word).all()  # words, pairs, a skip pair; no stem is so short


AWKWARD = [
    (None, "first text of none at all here", "en", "a", 30), (None, "second words of nobody else at that", "en", "b", 33), (3, "three has a text of its own", "en", None, 5), (3, "and three has another text besides it", None, "a", None),
    (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \n ", "en", "a", 3), (7, "seven says what seven says and repeats", "de", "c", 38), (7, "seven says what seven says and repeats", "de", "c", 38),
    (8, "seven says what seven says and repeats", "de", "c", 38), (None, None, None, None, None), (None, "", None, None, 0), (9, "w " * 30_000, "en", "a", 60_000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids, null, empty and long texts, a repeated row, and further columns with names that the stages use."""
    rows = [(*r, "x", 1, 2, False) for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, copies int, key int, every boolean").repartition(3)


def test_near_duplicates_stage_keeps_what_is_no_copy(spark, awkward):
    got = sorted((tuple(r) for r in stages.near_duplicates_stage(spark, awkward, "").collect()), key=str)
    assert got == sorted((r for r in dict.fromkeys(AWKWARD) if r[0] != 8), key=str)
    assert stages.near_duplicates_stage(spark, awkward.limit(0), "").count() == 0


def test_repeats_stage_on_awkward_rows(spark, awkward):
    got = sorted(((r.doc_id, r.text) for r in stages.repeats_stage(spark, awkward, "").collect()), key=str)
    texts = [(i, t or "") for i, t, *_ in AWKWARD]
    assert got == sorted(texts, key=str)  # no window of 50 bytes stands in two documents
    assert stages.repeats_stage(spark, awkward.limit(0), "").columns == list(stages.COLUMNS)


def test_mixing_stage_takes_each_text_for_itself(spark, awkward):
    from collections import Counter

    want = Counter()
    for r in mix_sources(awkward, carry=("text",)).collect():
        want[r.doc_id, r.text] += r.copies
    got = Counter((r.doc_id, r.text) for r in stages.mixing_stage(spark, awkward, "").collect())
    assert got == +want and sum(1 for k in got if k[0] is None) >= 3
    assert stages.mixing_stage(spark, awkward.limit(0), "").count() == 0


def test_quality_and_packing_stages_on_awkward_rows(spark, awkward, tmp_path):
    spark.createDataFrame([(3, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = stages.quality_stage(spark, awkward, str(tmp_path))
    assert kept.columns == list(stages.COLUMNS) and stages.quality_stage(spark, awkward.limit(0), str(tmp_path)).count() == 0
    packed = stages.packing_stage(spark, awkward, "").collect()
    assert sum(r.piece == 0 for r in packed) == len(AWKWARD) and max(r.piece for r in packed) >= 7  # the long one is cut
    assert stages.packing_stage(spark, awkward.limit(0), "").count() == 0


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Each stage's documents and texts, against plain versions on what the stage before kept."""
    import corpus_pipeline
    from tests.llm.test_documents import brute_components, last, sets_of

    rows, labels = labelled(seed=5, n=260)
    passage = " ".join(f"shared{i}" for i in range(20))
    rows = [r for r in rows if r[0] is not None and len(r[1]) < 100_000]
    rows += [(1000 + i, r[1] + (" tail" if i % 2 else ""), *r[2:]) for i, r in enumerate(rows[:40])] + [(2000 + i, f"{' '.join(f'own{i}x{j}' for j in range(30))} {passage} end{i}", "en", "s9", 9) for i in range(10)]
    rows += [(None, "a text that has no id but words", "en", "s1", 9), (7, "a second text for number seven", "en", "s2", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: (last(r[0]), r[1] or "")
    now, stage = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)

    def after(name):
        stage[name](spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        return df, [tuple(r) for r in df.collect()]

    scored = quality(now, spark.read.parquet(str(tmp_path / "labels.parquet")))
    keep = sorted((last(r.doc_id), r.keep) for r in scored.collect())
    now, kept = after("quality_classifier")
    assert sorted(key(r)[0] for r in kept) == [i for i, k in keep if k]

    named = {(i, t): k for k, (i, t) in enumerate(sorted({key(r) for r in kept}))}  # each text under an id for itself, in order
    component = brute_components(sets_of([(named[key(r)], r[1]) for r in kept]))
    now, got = after("ngram_jaccard_join")
    assert sorted(named[key(r)] for r in got) == sorted(set(component.values())) and len(got) < len(kept)

    first = {}
    for i, t in sorted(map(key, got)):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, t in map(key, got):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        if not len(b) or not gone.all():
            want.append((i, np.frombuffer(b, np.uint8)[~gone].tobytes().decode()))
    before = now
    now, got = after("suffix_array_dedup")
    assert sorted(map(key, got)) == sorted(want) and {t for _, t in want} != {r.text for r in before.collect()}

    copies = sorted(k for r in mix_sources(now, carry=("text",)).collect() for k in [(last(r.doc_id), r.text)] * r.copies)
    now, got = after("source_mixing")
    assert sorted(map(key, got)) == copies

    library = encoder(public_tokenizers.path("word_bpe_49k.json")).library
    sizes = sorted((last(r[0]), len(library.encode(r[1], add_special_tokens=False).ids) + 1) for r in got)
    packed = stage["best_fit_packing"](spark, now, str(tmp_path)).collect()
    assert sorted((last(r.doc_id), r.length) for r in packed) == sizes and all(r.piece == 0 for r in packed)
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 4096 and sorted(at for at, _ in p) == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() for p in by.values())


def test_pipeline_stages(spark, tmp_path, sample):
    import corpus_pipeline

    docs, labels, _ = sample
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = now.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k < 3:
            assert 0 < now.count() <= seen
            seen = now.count()
        if name == "ngram_jaccard_join":
            assert now.select("doc_id").distinct().count() == now.count()
    packed = now.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert packed and max(r[1] for r in packed) <= 4096
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_near_duplicates_stage_decides_by_set(spark):
    from tracewright.llm.stages import near_duplicates_stage

    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))
    near = lambda t: t.rsplit(" ", 1)[0]
    p, q, u1, u2, v1, v2 = (text() for _ in range(6))
    stay = [(5, p), (9, q), (None, u1), (None, u2), (12, v1), (12, v2), (None, ""), (None, ""), (13, None)]
    gone = [(None, near(p)), (None, near(q)), (12, v1), (12, near(v2)), (13, None)]  # of v2 and its copy under one doc_id either can stay
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in stay + gone], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = near_duplicates_stage(spark, docs, "").collect()
    assert sorted(str((r.doc_id, v2 if r.text == near(v2) else r.text)) for r in got) == sorted(map(str, stay))
