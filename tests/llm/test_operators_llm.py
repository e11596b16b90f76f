"""All ten operators on a small fixture of hard cases, against brute force."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandflow.llm import media, toxicity
from strandflow.llm.chat import collapse_snapshots
from strandflow.llm.decontamination import Myers, drop_leaks, find_leaks, normal
from strandflow.llm.licenses import BASE, scan_licenses
from strandflow.llm.mixing import mix_sources, plan_mix
from strandflow.llm.ngram_join import keep_one, link_components
from strandflow.llm.repeats import LENGTH, remove_repeats, repeated_windows
from strandflow.llm.sharding import plan_shards
from strandflow.llm.sigtree import SignatureTree
from strandflow.llm.token_output import WordEncoder, find_tokens, token_index, tokens_at, write_tokens
from strandflow.llm.wavelet import WaveletMatrix, build

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["er", "lo", "ta", "ñi", "sé", "qu", "an"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(140)
    edit = base.split()
    edit[60] = "changed"
    return [
        base, base, " ".join(edit), " ".join([*edit, "tail"]), base.upper(), None, "", " \n\t", "one", "one two", "one two three", "One Two Three",
        prose(30) + " " + passage + " " + prose(20), passage + prose(10), prose(5) + "\n" + passage, prose(3000), "x" * 5000, "ab" * 700, "\x00nul İ K",
        "Licensed under the Apache License, Version 2.0. mit-license cc by by", "GNU general\npublic license x gnu general public license",
        base, prose(80),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 4}", 1, 2) for i, t in enumerate(_texts())]
    rows += [(0, _texts()[0], "en", "s0", 1, 2), (None, _texts()[0], "en", None, 1, 2), (None, None, None, None, None, None), (5, "other text for a repeated id", "en", "s1", 1, 2)]
    # Extra columns whose names clash with the operators' own.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, th int").repartition(3).checkpoint()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false").checkpoint()


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def shingles(text, k):
    w = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_components(docs, k, num):
    rows = pairs(docs)
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(str((d, len(sets[i]), least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))
    got = link_components(docs, k, num, 100).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got for _ in range(r.copies)) == want


def test_keep_one(docs, nothing):
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    texts = Counter(r.text for r in kept.collect())
    assert texts[_texts()[0]] + texts[_texts()[2]] == 1
    assert texts[None] == 2 and texts[""] == 1 and texts["one two three"] + texts["One Two Three"] == 1
    assert keep_one(nothing).count() == 0 and link_components(nothing).count() == 0


def test_signature_tree_blocks():
    rng = random.Random(5)
    sets = []
    for _ in range(60):
        base = rng.sample(range(10**6), rng.randint(1, 60))
        for _ in range(rng.randint(1, 4)):
            sets.append(np.unique(np.array([b if rng.random() < 0.95 else rng.randrange(10**6) for b in base], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    rng.shuffle(sets)
    side = np.array([rng.randrange(2) for _ in sets])
    for where in (None, side):
        roots = SignatureTree(sets, 80, 100).link(where)
        up = list(range(len(sets)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if (where is None or where[a] != where[b]) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
        assert len({(find(i), roots[i]) for i in range(len(sets))}) == len(set(roots)) == len({find(i) for i in range(len(sets))})


def test_shards(docs, nothing):
    rows = plan_shards(docs, 4).collect()
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in rows) == sorted(str((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t in pairs(docs))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    share = Counter((r.source, r.shard) for r in rows)
    for s in {r.source for r in rows}:
        counts = [share[s, h] for h in range(4)]
        assert max(counts) - min(counts) <= 2
    assert plan_shards(nothing).count() == 0


def test_mix(docs, nothing):
    rows = plan_mix(docs, block=4).collect()
    taken = lambda r: sum(p["upto"] - p["from"] for p in r.pieces)
    assert sorted(str((r.doc_id, r["size"])) for r in rows) == sorted(str((d, len(WORDS.findall(t or "")))) for d, t in pairs(docs))
    size, got, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r["size"]
        got[r.source] += taken(r)
        target[r.source] = r.target
        assert taken(r) <= 3 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    free, left, want = set(order), sum(size.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if 3 * size[s] < level * weight[s] - 1e-9}
        if not capped:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 3 * size[s] for s in capped}
        left -= sum(3 * size[s] for s in capped)
        free -= capped
    for s in order:  # multinomial counts of blocks of four words: five standard deviations, and a block at each end
        assert target[s] == pytest.approx(want[s]) and abs(got[s] - want[s]) <= 5 * (4 * want[s]) ** 0.5 + 8
    assert sorted(map(str, rows)) == sorted(map(str, plan_mix(docs, block=4).collect()))
    mixed = mix_sources(docs, block=4)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORDS.findall(r.text))
    assert {s: n for s, n in got.items() if n} == {s: n for s, n in words.items() if n}
    assert plan_mix(nothing).count() == 0


def test_mix_is_multinomial(spark):
    """Counts a shard have a multinomial's mean and variance, and every source's blocks are taken once a pass."""
    from strandflow.llm import mixing
    from strandflow.llm.workspace import Workspace

    shares, slots, shards = {"a": 0.5, "b": 0.3, None: 0.2}, 400, 500
    rows = [(s, 10**6, float(slots * shards * 8 * x)) for s, x in shares.items()]
    targets = spark.createDataFrame(rows, "source string, source_size long, target double")
    drawn, _ = mixing._draw(targets, 8, slots, 7, Workspace(spark, "draw"))
    got = drawn.collect()
    for s, x in shares.items():
        counts = np.zeros(shards)
        for r in got:
            if r.source == s:
                counts[r.shard] = r["count"]
        assert abs(counts.mean() - slots * x) < 5 * (slots * x * (1 - x) / shards) ** 0.5
        assert 0.7 < counts.var() / (slots * x * (1 - x)) < 1.35
        firsts = sorted((r.shard, r["first"], r["count"]) for r in got if r.source == s)
        assert [f for _, f, _ in firsts] == np.concatenate(([0], np.cumsum([c for *_, c in firsts])[:-1])).tolist()
    sizes = [1, 2, 3, 5, 16, 17, 1000, 7813, 50_001]
    df = spark.createDataFrame([(n, k) for n in sizes for k in range(2)], "n long, key long").selectExpr("n", "key", "explode(sequence(0L, n - 1)) AS i")
    places = {}
    for r in mixing.permuted(df, "i", "n", "key", "p").select("n", "key", "i", "p").collect():
        places.setdefault((r.n, r["key"]), {})[r.i] = r.p
    for (n, _), p in places.items():
        assert sorted(p.values()) == list(range(n))
        if n > 900:
            steps = Counter((p[i + 1] - p[i]) % n for i in range(n - 1))
            assert sum(p[i] == i for i in p) < 12 and max(steps.values()) < 12
    assert places[1000, 0] != places[1000, 1]


def test_tokens(docs, nothing):
    tk = Tokenizer.from_file(TOKENIZER)
    coded = {t: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for _, t in pairs(docs)}
    rows = token_index(docs, TOKENIZER, shard_tokens=500).collect()
    key = lambda d, ids: str((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in rows) == sorted(key(d, coded[t]) for d, t in pairs(docs))
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert token_index(nothing, TOKENIZER).count() == 0


def test_token_lookups(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    manifest = write_tokens(docs, TOKENIZER, folder, shard_tokens=500).checkpoint()
    assert manifest.count() > 2
    files = sorted((r.part, r.seq, r.path) for r in manifest.collect())
    every = np.concatenate([WaveletMatrix(open(path, "rb").read()).decode() for _, _, path in files])
    tokens = [1, int(every[0]), 48_000, 1 << 20]
    places = {}
    for r in find_tokens(manifest, folder, tokens, 5).collect():
        places.setdefault(r.token, []).append((r.places[0], r.n, r.places))
    for t in tokens:
        want = np.flatnonzero(every == t).tolist()
        assert sum(n for _, n, _ in places.get(t, ())) == len(want)
        assert all(set(p) <= set(want) and len(p) == min(5, n) for _, n, p in places.get(t, ()))
    asked = [0, 5, 501, len(every) - 1, len(every)]
    got = tokens_at(manifest, folder, spark.createDataFrame([(a,) for a in asked], "place long")).collect()
    assert {r.place: r.token for r in got} == {a: every[a] for a in asked[:-1]}


def test_malformed_utf8(spark):
    tk = Tokenizer.from_file(TOKENIZER)
    bad = [b"ab\xff, cd", b"\xe2\x82 x", b"\xc3", "é.".encode()[:-2] + b"."]
    docs = spark.createDataFrame(list(enumerate(bad)), "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) AS text")
    for r in token_index(docs, TOKENIZER).collect():
        ids = [*tk.encode(bad[r.doc_id].decode(errors="replace"), add_special_tokens=False).ids, 1]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    bench = spark.createDataFrame([(1, "ab cd")], "item_id long, text string")
    assert find_leaks(docs, bench).count() == 1
    marks = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, toxicity.train(docs, marks)).count() == 4


def test_word_encoder():
    tk, mine, rng = Tokenizer.from_file(TOKENIZER), WordEncoder(TOKENIZER), random.Random(1)
    signs = [*"aAbZ. ,'!?\n\té́İΣ\xa0\x0b\x1c\x85sStT1٣é…ß", "<|endoftext|>", "<|ENDOFTEXT|>", "J̌", "'s", " "]
    for _ in range(3000):
        s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert mine.encode([s.encode()])[0].tolist() == tk.encode(s, add_special_tokens=False).ids


def test_wavelet():
    rng = random.Random(2)
    for n, top in ((0, 1), (1, 1), (70_000, 40), (3000, 49_000)):
        ids = np.array([rng.randrange(top) for _ in range(n)], np.uint32)
        w = WaveletMatrix(build(ids, [3, None], np.array([n, 0])))
        assert (w.decode() == ids).all() and w.doc_ids == [3, None] and w.lengths.tolist() == [n, 0]
        for _ in range(60 if n else 0):
            i, token = rng.randrange(n), int(ids[rng.randrange(n)])
            places = np.flatnonzero(ids == token)
            k = rng.randrange(len(places))
            assert w.access(i) == ids[i] and w.count(token, i) == int((ids[:i] == token).sum()) and w.occurrence(token, k) == places[k]
        assert w.count(1 << 20) == 0


def test_media(docs, nothing):
    rows = media.media_digest(docs).collect()
    want = []
    for d, t in pairs(docs):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append(str((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44)))
    assert sorted(str(tuple(r)[:6]) for r in rows) == sorted(want)
    assert all(r.feature.startswith("audio/wav;") for r in rows) and media.media_digest(nothing).count() == 0


def test_sniff(spark):
    import gzip
    import io
    import struct
    import zipfile

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a", "b")
    whole = {"image/png": png, "image/gif": gif, "image/bmp": bmp, "application/gzip": gzip.compress(b"hi"), "application/zip": buf.getvalue(), "audio/wav": media.wav(b"ab")}
    for kind, data in whole.items():
        assert media.sniff(data) == [(kind, 0, len(data))]
        assert media.sniff(b"junk" + data + b"BM PK\x03\x04 junk") == [(kind, 4, len(data))]
        assert media.sniff(data[:-1]) == []
    pdf = b"%PDF-1.4\n" + png + b"\nstartxref\n9\n%%EOF"
    assert media.sniff(pdf + b"\nmore\nstartxref\n1\n%%EOF") == [("application/pdf", 0, len(pdf) + 23), ("image/png", 9, len(png))]
    assert media.sniff(pdf + pdf)[2] == ("application/pdf", len(pdf), len(pdf))
    store = io.BytesIO()
    with zipfile.ZipFile(store, "w") as z:
        z.writestr("p", png)
    assert [k for k, *_ in media.sniff(store.getvalue())] == ["application/zip", "image/png"]
    flac = b"fLaC\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8" + b"frames"
    assert media.sniff(flac + gif) == [("audio/flac", 0, len(flac)), ("image/gif", len(flac), len(gif))]
    assert media.sniff(b"%PDF-1 PK\x03\x04" * 100_000) == []  # in time that grows with the length alone
    rows = [(1, png + b"x" + gif, "image/jpeg"), (2, gif, "image/gif"), (3, None, None), (4, b"text", "image/png")]
    got = {r.id: r for r in media.sniff_column(spark.createDataFrame(rows, "id int, blob binary, declared string"), "id", "blob", "declared").collect()}
    assert got[1].type == "image/png" and got[1].corrected and bytes(got[1].carved[0]["bytes"]) == gif
    assert not got[2].corrected and not got[3].corrected and got[4].corrected
    none = spark.createDataFrame([], "id int, blob binary, declared string, k int, type string")
    assert media.sniff_column(none, "id", "blob", "declared").count() == 0


def test_repeats(docs, nothing):
    rows = [(d, (t or "").encode()) for d, t in pairs(docs)]
    seen = Counter(b[i : i + LENGTH] for _, b in rows for i in range(len(b) - LENGTH + 1))
    want = []
    for d, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        edge = np.diff(np.concatenate(([False], gone)).astype(np.int8))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        want.append(str((d, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())))
    got = remove_repeats(docs).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(want)
    assert remove_repeats(nothing).count() == 0


def test_hot_keys_of_repeats(docs, monkeypatch):
    from strandflow.llm import repeats

    usual = sorted(map(str, remove_repeats(docs).collect()))
    monkeypatch.setattr(repeats, "HOT", 0)
    assert sorted(map(str, remove_repeats(docs).collect())) == usual


def test_radix_groups():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab") for _ in range(3)) * 200 for _ in range(6)] + [rng.randbytes(600)]
    starts = [len(t) - LENGTH + 1 for t in texts]
    seen = Counter(t[i : i + LENGTH] for t, n in zip(texts, starts, strict=True) for i in range(n))
    for t, n, flags in zip(texts, starts, repeated_windows(texts, starts), strict=True):
        assert flags.tolist() == [seen[t[i : i + LENGTH]] > 1 for i in range(n)]


def test_leaks(spark, docs, nothing):
    item = " ".join(_texts()[22].split()[10:50])
    edited = item.replace("a", "b", 3)
    bench = spark.createDataFrame([(1, item.upper()), (2, None), (3, ""), (4, "zz unrelated item text of its own"), (5, item), (None, "one two three")], "item_id long, text string")
    more = spark.createDataFrame([(90, "x " + edited + " y"), (91, item[: len(item) // 2])], "doc_id long, text string")
    got = find_leaks(docs.select("doc_id", "text").union(more), bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(22, 1, 0), (22, 5, 0), (90, 1, 3), (90, 5, 3), (10, None, 0), (11, None, 0)}
    assert find_leaks(nothing, bench).count() == find_leaks(docs, bench.where("false")).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    items = [" ".join(word() for _ in range(rng.randint(4, 16))) for _ in range(12)]
    texts = []
    for n in range(80):
        t = list(rng.choice(items))
        for _ in range(n % 7):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz", " "])
        texts.append(" ".join(word() for _ in range(rng.randint(0, 6))) + " " + "".join(t) + " " + " ".join(word() for _ in range(rng.randint(0, 6))))
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            p, row = normal(item), [0] * (len(normal(t)) + 1)
            for k, a in enumerate(p, 1):
                new = [k]
                for j, b in enumerate(normal(t), 1):
                    new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
                row = new
            if min(row) <= int(0.06 * len(p)):
                want.add((d, i, min(row)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len({x for *_, x in want}) > 3
    assert len(got) == len(want)


def test_stages_on_clashing_and_empty_tables(spark, docs):
    """Each filtering stage keeps columns of any name, and an empty table stays empty."""
    names = ["bad_id", "bad_th", "drop_id", "drop_th", "mark", "th", "nth", "p_id", "p_th", "p_nth", "p_size", "cuts", "_size", "_pieces", "_id", "toxic", "label_id", "component", "class", "node", "root", "h", "b", "at"]
    wide = docs.select("doc_id", "text", "lang", "source", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, " ".join(_texts()[22].split()[10:50])), (None, None)], "item_id long, text string")
    for stage in (lambda d: toxicity.drop_toxic(d, labels), keep_one, lambda d: drop_leaks(d, bench), lambda d: mix_sources(d, block=4)):
        kept = stage(wide)
        assert kept.columns == wide.columns
        assert all(tuple(r)[4:] == tuple(range(len(names))) for r in kept.collect())
        assert stage(wide.where("false")).count() == 0
    assert {r.doc_id for r in drop_leaks(wide, bench).collect()} == {r.doc_id for r in wide.collect()} - {22}
    assert drop_leaks(wide, bench.where("false")).count() == wide.count()
    assert token_index(wide, TOKENIZER).count() == wide.count()
    toxicity.score_documents(wide, toxicity.train(wide.withColumn("text", F.lit(None).cast("string")), labels)).count()


def test_myers():
    rng = random.Random(4)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 12), rng.randint(0, 20)))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        assert Myers(p).best(t)[0] == min(row)
    assert normal("Ab, c_d") == " ab c d "


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"),
            (4, 0, "user", "a"), (4, 1, "assistant", "x"), (5, 0, None, None), (6, 0, "user", "a"), (None, 0, "user", "z"), (7, None, "user", "q"), (7, 1, "user", "r")]
    got = {r.conv_id: r for r in collapse_snapshots(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 4, 5, 7, None}
    assert got[2].merged == 2 and got[2].n_turns == 3
    assert got[2].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert collapse_snapshots(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_licenses(docs, nothing):
    want = []
    for d, t in pairs(docs):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        at, labels = [], set()
        for phrase, label in BASE:
            p = phrase.encode().split()
            here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.append(str((d, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))))
    rows = scan_licenses(docs).collect()
    assert sorted(str(tuple(r)[:6]) for r in rows) == sorted(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert any("apache-2.0" in r.labels for r in rows) and scan_licenses(nothing).count() == 0


def test_toxicity(spark, nothing):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["er", "lo", "ta", "ni", "se", "qu", "an", "th", "in"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            insult = rng.choice(["idiot", "moron", "scum"])
            at = rng.randrange(len(insult))
            words.insert(rng.randrange(len(words)), insult if rng.random() < 0.7 else insult[:at] + "*" + insult[at:])
        rows.append((i, " ".join(words)))
        labels.append((i, None, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    held = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert sum((got[i] >= 0.5) == y for i, y in held.items()) / len(held) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "an i-d-i-o-t there"), (4, "m o r o n"), (5, "z" * 5000)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_documents(odd, model).collect()}
    assert score[1] == score[2] < 0.5 <= min(score[3], score[4]) and 0 <= score[5] <= 1
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and 440 <= kept.count() <= 460
    assert toxicity.score_documents(nothing, toxicity.train(nothing, marks.where("false"))).count() == 0


def test_kernel_is_the_string_kernel():
    def phi(w):
        w = "\0" + w
        out = Counter()
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1 - 3)
        return out

    words = ["idiot", "idi-ot", "moron", "banana", "abc"]
    chart = toxicity.Nystrom(words)
    f = [phi(w) for w in words]
    dot = lambda a, b: sum(a[x] * b[x] for x in a)
    want = [[dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 for b in f] for a in f]
    assert np.allclose(chart.kernel(words), want, atol=1e-4)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "token_output"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = corpus_pipeline.token_output(spark, docs, sf)
    assert left.count() == docs.count()
    assert left.agg(F.sum("n_tokens")).first()[0] == left.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
    json.dumps([n for n, _ in corpus_pipeline.STAGES])
