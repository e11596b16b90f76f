"""Small cases in which an operator once did less than the whole job."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandflow.llm import ngram_join, repeats, toxicity
from strandflow.llm.components import components
from strandflow.llm.license_texts import TEXTS
from strandflow.llm.licenses import BASE, LEAST, TEMPLATES, _index, plain, scan_licenses
from strandflow.llm.ngram_join import SPARE, STRETCH, keep_one, link_components, range_keys
from strandflow.llm.repeats import LENGTH, remove_repeats, runs_of
from strandflow.llm.sigtree import bitmap, candidates
from strandflow.llm.token_output import WordEncoder
from strandflow.llm.workspace import LEAST_PARTS


def _prose(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def _kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def test_keep_one_of_unlike_texts_under_one_id(spark):
    a, b = _prose("a"), _prose("b")
    assert _kept(spark, [(5, a), (5, b)]) == [(5, a), (5, b)]
    near = lambda t: t + " tail"
    assert _kept(spark, [(5, a), (9, near(a)), (5, b), (12, near(b)), (5, near(b)), (5, a)]) == [(5, a), (5, min(b, near(b), key=lambda t: _th(spark, t)))]


def _th(spark, text):
    return spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t)").first()[0]


def test_keep_one_of_near_copies_without_ids(spark):
    a, b = _prose("a"), _prose("b")
    kept = _kept(spark, [(None, a), (None, a + " tail"), (None, b), (7, b + " tail"), (None, ""), (None, "")])
    assert len([t for d, t in kept if t in (a, a + " tail")]) == 1
    assert [t for d, t in kept if t in (b, b + " tail")] == [b + " tail"]
    assert [t for d, t in kept if t == ""] == ["", ""] and len(kept) == 4


def test_rare_toxic_rows_are_all_learnt(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice(["er", "lo", "ta", "ni", "se", "qu"]) for _ in range(3)) for _ in range(12))) for i in range(400)]
    bad = [i for i in range(400) if i % 40 == 7]
    rows = [(i, t + " moron" if i in bad else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Labels of documents that are not there take no one's place in the sample.
    marks = [(i, int(i in bad)) for i in range(400)] + [(i, i % 2) for i in range(1000, 3000)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=40)
    score = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert all(score[i] >= 0.5 for i in bad)
    assert sum(score[i] >= 0.5 for i in score if i not in bad) <= 4


def test_license_texts_against_brute_force(spark):
    """Labels and scores of whole texts, embedded, cut, changed and shifted, against all alignments of all templates."""
    rng = random.Random(5)
    texts = [f"header {rng.random()}\n{t}\nend" for _, t, _ in TEXTS]
    for _, t, _ in TEXTS[:16]:
        words = t.split()
        at, n = rng.randrange(len(words)), len(words)
        texts += [" ".join(words[: n // 2]), " ".join([*words[:at], "zzz", *words[at + 1 :]]), " ".join([*words[: n // 3], "zzz", *words[n // 3 :]]), t.upper() + " " + t]
        texts.append(" ".join(w if rng.random() < 0.7 else "zzz" for w in words))
    texts += [None, "", "hereby", "hereby " * 300, "nothing of the kind"]
    shares, found = _index()
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen = set()
    for n, t in enumerate(texts):
        words = plain(t or "").split()
        s = " " + " ".join(words) + " "
        score = {}
        for k, j, i in {(k, j, i) for i, w in enumerate(words) for k, j in found.get(w, ())}:
            score[k, i - j] = sum(x for m, (w, x) in enumerate(shares[k]) if 0 <= i - j + m < len(words) and words[i - j + m] == w)
        every = max((sum(x for m, (w, x) in enumerate(sh) if 0 <= o + m < len(words) and words[o + m] == w) for sh in shares for o in range(-len(sh), len(words))), default=0) if n % 9 == 0 else 0
        best = max(score.values(), default=0)
        assert every < LEAST or abs(every - best) < 1e-9  # no alignment that counts is left out
        base = {label for phrase, label in BASE if f" {phrase} " in s}
        labels = base | {TEMPLATES[k][0] for (k, _), x in score.items() if round(x, 9) >= LEAST and any(f" {p} " in s for p in TEMPLATES[k][2])}
        assert got[n].labels == ",".join(sorted(labels)), t
        assert abs(got[n].score - (1 if base else min(best, 1))) < 1e-8, t
        seen |= labels
    assert {label for label, _, _ in TEXTS} <= seen


def test_license_score_does_not_hang_on_unrelated_words(spark):
    texts = [t for _, t, _ in TEMPLATES]
    bsd = "redistribution and use in source and compiled forms with or without modification are permitted"
    texts += [bsd, bsd + " xx apache", "redistribution of use in sourse", "xx", "are", "modification yy permitted"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {r.doc_id: r.score for r in scan_licenses(rows).collect()}
    shares, found = _index()
    for n, t in enumerate(texts):
        words = t.split(" ")
        votes = {(k, i - j) for i, w in enumerate(words) for k, j in found.get(w, ())}
        best = max((sum(x for j, (w, x) in enumerate(shares[k]) if 0 <= o + j < len(words) and words[o + j] == w) for k, o in votes), default=0)
        assert score[n] in (1, round(best, 9)), t
    at = len(TEMPLATES)
    assert LEAST < score[at] == score[at + 1] < 1


def test_linked_sets_share_a_key():
    """Sets of at most d differences share a range's key in their slot, whatever their sizes and empty ranges."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 9, 20, 60, 300):
        for _ in range(60):
            d = int(rng.integers(0, max(1, n // 4) + 1))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            gone = int(rng.integers(0, min(d, len(a) - 1) + 1))
            b = np.unique(np.concatenate((a[gone:] if rng.random() < 0.5 else np.delete(a, rng.choice(len(a), gone, replace=False)), rng.integers(0, 2**63, d - gone, dtype=np.uint64))))
            left, right = range_keys(a, 7, d), range_keys(b, 7, d)
            assert len(np.intersect1d(left, right)), (n, d)
            m = d + 1 + SPARE + int(STRETCH * (d + 1))
            assert len(left) in (d + 1, m)


def test_linked_sets_share_a_key_of_common_shingles():
    rng = np.random.default_rng(4)
    known = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2))
    common = ngram_join.Common(known[::-1], np.arange(4, 4 + len(known)))
    assert (common.levels(known) > 0).all() and not common.levels(known + np.uint64(1)).any()
    for n in (4, 20, 60, 300):
        for _ in range(60):
            d = int(rng.integers(0, n // 4 + 1))
            a = np.unique(np.concatenate((rng.choice(known, n // 2), rng.integers(0, 2**63, n // 2, dtype=np.uint64))))
            gone = int(rng.integers(0, min(d, len(a) - 1) + 1))
            b = np.unique(np.concatenate((np.delete(a, rng.choice(len(a), gone, replace=False)), rng.choice(known, d - gone))))
            left, right = (range_keys(x, 7, d, common.levels(x)) for x in (a, b))
            assert len(np.intersect1d(left, right)), (n, d)


def test_common_lines_join_no_candidates(spark):
    """Most unlike texts that repeat the same few lines stay out of the trees, and near copies among them are found."""
    rng = random.Random(8)
    lines = [_prose(f"line{n}w", 12) for n in range(6)]
    texts = ["\n".join([_prose(f"own{n}w", 120), *rng.sample(lines, 4)]) for n in range(400)]
    texts += [f"tail {t} end" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    figures = {}
    got = {r.doc_id: r.component_id for r in link_components(docs, 5, 80, 100, figures=figures).collect()}
    assert got == {i: i - 400 if i >= 400 else i for i in range(420)}
    assert figures["tested"] < 30_000, figures


def test_words_of_letters_need_no_mark():
    """Plain words go to the library without a mark after each; where their number of last ids is not theirs, marks come back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(9)
    letters = "abcdeXYZ\u00e9\u00fc\u00df\u00f1\u0130\u0149\u01c6\u0301'.,1\u00b6|"
    texts = ["".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice("abcde ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["plain words only", "\u00e9t\u00e9 \u0131 \u017f \u0149a", "a<|endoftext|>b"]
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    class Spy:
        given: list[str] = []

        def encode_batch_fast(self, lots, **how):
            self.given += lots
            return library.encode_batch_fast(lots, **how)

    for pattern in (None, "^.+$"):
        words = WordEncoder(path)
        words._tokenizer = Spy()
        words._letters = pattern or words._letters
        for part in (texts, texts[::-1]):
            ids, at = words.encode([t.encode() for t in part])
            assert [ids[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] == (want if part is texts else want[::-1])
    words = WordEncoder(path)
    words._tokenizer, Spy.given = Spy(), []
    words.encode([b"plain words only, " * 3])
    assert sum(len(t.split()) for t in Spy.given) < 8


def test_candidates_of_bitmaps():
    rng = random.Random(3)
    sets, known = [], []
    for n in range(40):
        base = rng.sample(range(10**6), rng.randint(1, 60))
        for _ in range(rng.randint(1, 5)):
            sets.append(np.unique(np.array([b if rng.random() < 0.96 else rng.randrange(10**6) for b in base], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            known.append(n if rng.random() < 0.5 else 1000 + len(sets))
    for m in (1, 2, 9, len(sets)):
        maps, sizes = np.stack([bitmap(s, 256) for s in sets[:m]]), np.array([len(s) for s in sets[:m]])
        pairs, tested, pruned = candidates(maps, sizes, np.array(known[:m]), 80, 100)
        got = {frozenset(p) for p in pairs.tolist()}
        want = {frozenset((i, j)) for i in range(m) for j in range(i) if known[i] != known[j] and 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))}
        assert want <= got and len(got) == len(pairs) and tested >= pruned
        assert all(known[i] != known[j] for i, j in map(tuple, got)) and len(got) <= m * m / 8 + 1


@pytest.mark.parametrize("pivots", [0, 4])
def test_groups_of_several_blocks(spark, monkeypatch, pivots):
    """Near copies, chains and strangers in candidate groups cut into blocks of a few sets, against brute force."""
    rng = random.Random(12)
    texts = []
    for tag in "abcd":
        words = _prose(tag, 60).split()
        for n in range(25):
            texts.append(" ".join([*words[: 60 - n % 13], *[f"{tag}{n % 13}x{rng.randrange(4)}y{i}" for i in range(n % 13)]]))
    texts += [f"{t} {x}" for t in texts[:20] for x in ("tail", "end")]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 6)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    figures = {}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(docs, 3, 80, 100, figures=figures).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 4 and figures["large_units"] and figures["tested"] >= figures["pruned"] > 0
    plain = {r.doc_id: r.n_links for r in ngram_join.link_components(docs, 3, 80, 100, links=True).collect()}
    assert plain == {i: sum(i != j and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}


def test_number_of_links(spark):
    rng = random.Random(6)
    texts = [None, "", "one two", "one two"]
    for tag in "abc":
        words = _prose(tag, 80).split()
        for _ in range(14):
            at = rng.randrange(60, 80)
            texts.append(" ".join([*words[:at], *[f"x{rng.randrange(3)}" for _ in range(rng.randrange(12))], *words[at:]]))
    rows = list(enumerate(texts)) + [(9, texts[9]), (9, texts[9]), (None, texts[9])]
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := (t or "").split()) else set() for _, t in rows]
    links = [sum(i != j and bool(a) and 100 * len(a & b) >= 90 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = link_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, links=True).collect()
    want = sorted(str((d, n)) for (d, _), n in zip(rows, links, strict=True))
    assert sorted(str((r.doc_id, r.n_links)) for r in got for _ in range(r.copies)) == want
    assert len(set(links)) > 5


def test_hash_pass_memory():
    """Hashing and dealing out keys takes little memory beside the keys themselves; the keys are those of each set alone."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 300)) for _ in range(1600)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "th", "text"])
    run = ngram_join._hash_pass(5, 80, 100, 204, (np.arange(8, dtype=np.uint64), np.full(8, 5)))
    found, rows = [], 0
    tracemalloc.start()
    try:
        for out in run(iter([batch])):
            rows += out.num_rows - out.column("n").null_count
            found += [np.frombuffer(x, np.uint64).reshape(-1, 2)[:, 0].sum(dtype=np.uint64) for x in out.column("keys").to_pylist() if x]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = np.uint64(0)
    bounds = ngram_join._slots()
    for s in ngram_join.shingle_sets([t.encode() for t in texts], 5):
        for slot in range(int(np.searchsorted(bounds, len(s), "right")) - 1, int(np.searchsorted(bounds, len(s) * 100 // 80, "right"))):
            if d := 2 * (int(bounds[slot + 1]) - 1) * 20 // 180:
                want += range_keys(s, slot, d, np.zeros(len(s), np.int8)).sum(dtype=np.uint64)
    assert rows == len(texts)
    assert np.sum(found, dtype=np.uint64) == want
    assert most < 60_000_000


def test_small_tables_of_the_join_take_few_partitions(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "48")
    spark.conf.set(names[1], "false")
    try:
        edges = spark.createDataFrame([(i, 0) for i in range(1, 40)] + [(100, 102), (102, 101)], "a long, b long")
        found = components(edges, 41)
        assert found.rdd.getNumPartitions() <= LEAST_PARTS
        assert {r.node: r.root for r in found.collect()} == {i: 0 for i in range(40)} | {100: 100, 101: 100, 102: 100}
        rows = [(i, _prose(f"w{i % 7}_") + " tail" * (i >= 7)) for i in range(14)] + [(99, None)]
        linked = link_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=90, den=100)
        assert linked.rdd.getNumPartitions() <= LEAST_PARTS
        assert {r.doc_id: r.component_id for r in linked.collect()} == {i: i % 7 for i in range(14)} | {99: 99}
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


@pytest.mark.parametrize("stretch_bytes", [None, 500])
def test_runs_of_many_small_tasks_travel_in_few_rows(spark, monkeypatch, stretch_bytes):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    line = text(600)
    texts = [text(1500) for _ in range(24)] + [text(300) + line + text(i) for i in range(10)] + [line[i : i + LENGTH] for i in range(3)]
    texts += [texts[0], texts[0][:800] + text(200), "ab" * 400, None, ""]
    if stretch_bytes:  # so little text makes a stretch only here
        monkeypatch.setattr(repeats, "STRETCHBYTES", stretch_bytes)
    dealt, frame = [], type(spark.range(0))
    usual = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *by: (dealt.append(self), usual(self, *by))[1])
    tasks, parts = 8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = remove_repeats(usual(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tasks).checkpoint())
    sent = next(df for df in dealt if "runs" in df.columns).select("part", "stretch", F.octet_length("runs").alias("size")).collect()
    data = [(t or "").encode() for t in texts]
    size = sum(len(b) for b in data if len(b) >= LENGTH)
    stretches = -(-size // (parts * stretch_bytes)) if stretch_bytes else 1
    assert len(sent) <= tasks * parts * stretches
    assert len({r.stretch for r in sent}) == stretches
    assert sum(r.size for r in sent) >= 40 * sum(len(runs_of(b)) for b in set(data))  # a text of two tasks goes twice
    seen = Counter(b[i : i + LENGTH] for b in data for i in range(len(b) - LENGTH + 1))
    want = []
    for d, b in enumerate(data):
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, off in zip(b, gone, strict=False) if not off)
        want.append((d, len(b), sum(gone), sum(gone[i] > gone[i - 1] for i in range(len(b))), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r)[:5] for r in got.collect()) == want
    assert sum(w[2] > 0 for w in want) >= 14
