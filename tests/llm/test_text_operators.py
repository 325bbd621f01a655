"""Operators over documents against brute-force versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ratiosift.llm import bloom, decontaminate, lm_scoring, near_dedup, packing, quality, shared, textkernel, toxicity
from ratiosift.llm.components import connected_components
from ratiosift.llm.queries import tokenizer_path
from ratiosift.llm.shared import Scratch

SCHEMA = "doc_id long, text string, source string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def corpus(seed=0, n=150):
    """Prose with exact copies, a large group of edited copies, a shared passage and odd rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 5)))
    prose = lambda k: [word() for _ in range(k)]
    passage, base = prose(60), prose(120)
    rows = [(k, " ".join(prose(r.randint(1, 200)))) for k in range(n)]
    rows += [(1000 + k, " ".join(prose(20) + passage + prose(r.randint(0, 30)))) for k in range(50)]
    for k in range(130):  # from nearly equal to dissimilar
        own = list(base)
        for _ in range(r.randint(0, 14)):
            own[r.randrange(len(own))] = word()
        rows.append((2000 + k, " ".join(own)))
    rows += [(3000 + k, rows[k % 7][1]) for k in range(40)] + [(3100, rows[3][1].upper())]
    rows += [(4000, None), (4001, ""), (4002, "  \n\t"), (4003, "one two"), (4004, "One  TWO"), (4005, "one two three"), (None, rows[0][1]), (4006, "x " * 3000)]
    return [(i, t, "src") for i, t in rows] + [(5, rows[5][1], "src")]  # a repeated row


def shingles(text):
    w = spaced(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_word_kernel_equals_regex():
    texts = ["Hello  wörld", "", None, "a\x0bb\tc", "É É", "x", " lead", "trail ", "0aZ-9_é!"]
    data, offsets = textkernel.text_bytes(pa.array(texts))
    for kinds, pattern in ((textkernel.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (textkernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = textkernel.Words(data, offsets, kinds)
        got = [lower(bytes(data[a:e]).decode()) for a, e in zip(w.start, w.end, strict=True)]
        want = [re.findall(pattern, lower(t)) for t in texts]
        assert got == sum(want, []) and w.counts.tolist() == [len(x) for x in want]
        same = {}
        for word, h in zip(got, w.hash.tolist(), strict=True):
            assert same.setdefault(word, h) == h
        assert len(set(same.values())) == len(same)
    sliced = textkernel.text_bytes(pa.array(texts).slice(3, 2))
    assert bytes(sliced[0]).decode() == texts[3] + texts[4]


def test_word_kernel_on_very_long_texts(monkeypatch):
    texts = ["ab cd " * 500, "x" * 3000 + " y", "", " q", None]
    data, offsets = textkernel.text_bytes(pa.array(texts))
    whole = textkernel.Words(data, offsets, textkernel.NOT_SPACE).hash
    monkeypatch.setattr(textkernel, "BLOCK_BYTES", 64)
    textkernel._power_tables.cache_clear()
    assert (textkernel.Words(data, offsets, textkernel.NOT_SPACE).hash == whole).all()
    monkeypatch.undo()
    textkernel._power_tables.cache_clear()
    data, offsets = textkernel.text_bytes(pa.array(["word and other " * 3_500_000]))  # 52 MB
    w = textkernel.Words(data, offsets, textkernel.NOT_SPACE)
    assert len(w.hash) == 10_500_000 and len(np.unique(w.hash[:3000])) == 3 and (w.hash[:3] == w.hash[-3:]).all()
    assert len(textkernel._power_tables()[0]) == textkernel.BLOCK_BYTES


def test_scratch_folder_where_none_is_named(spark, monkeypatch):
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="local[2]", getConf=lambda: SimpleNamespace(get=lambda k: None), applicationId="none named"))
    assert shared.shared_dir(unset) == shared.shared_dir(unset) and shared.shared_dir(unset).startswith("file:///")
    assert shared.free_name(["bad", "BAD_"], "bad") == "bad__"


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_bloom_never_drops(spark):
    made = bloom.build(spark.range(5000).selectExpr("id * 7919 as k"), "k")
    keys = np.arange(5000, dtype=np.int64) * 7919
    assert made.test(keys).all() and made.test(keys + 1).mean() < 0.02
    assert not bloom.build(spark.range(0), "id").test(keys).any()


@pytest.mark.parametrize("short_list", [near_dedup.SHORT_LIST, 3])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, short_list):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short_list)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 24)
    rows = corpus()
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    want = Counter((doc, len(sets[i]), least[find(i)]) for i, (doc, _, _) in enumerate(rows))
    out = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in out)
    assert {r.doc_id for r in out if r.kept} == {r.component_id for r in out}


def test_shared_boilerplate_is_far_from_quadratic(spark, monkeypatch):
    """2,000 texts of which half of each is one passage: none are linked, and the sketches leave few to verify."""
    r = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(100))
    rows = [(k, f"{passage} " + " ".join(f"w{r.randrange(10**7)}" for _ in range(r.randint(75, 110)))) for k in range(2000)]
    rows += [(5000 + k, rows[k][1] + " tail words") for k in range(20)]
    fetched, found = [], near_dedup.NearDuplicates._sets_of
    monkeypatch.setattr(near_dedup.NearDuplicates, "_sets_of", lambda self, nodes: fetched.append(nodes.select("node").distinct().count()) or found(self, nodes))
    out = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in out} == {k: k if k < 5000 else k - 5000 for k, _ in rows}
    assert sum(fetched) < 400


def test_links_at_the_threshold_are_not_lost(spark):
    """1,500 pairs of sets of similarity 0.75 exactly, far from all others."""
    rows = []
    for k in range(1500):
        common, own = [f"c{k}x{j}" for j in range(304)], [[f"d{k}s{s}x{j}" for j in range(50)] for s in (0, 1)]
        rows += [(2 * k + s, " ".join(common + own[s])) for s in (0, 1)]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 100 * len(a & b) == 75 * len(a | b)
    out = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.component_id != r.doc_id - r.doc_id % 2 for r in out) == 0


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    kept = near_dedup.deduplicated(spark, spark.createDataFrame([(1, "a b c d e f", "s"), (2, "A B C D E F", "t"), (2, "A B C D E F", "t"), (None, None, "u")], SCHEMA))
    assert kept.columns == ["doc_id", "text", "source"] and sorted(kept.collect(), key=str) == sorted([(1, "a b c d e f", "s"), (None, None, "u")], key=str)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(2)
    words = lambda k: [r.choice("abcdefgh") * r.randint(1, 2) for _ in range(k)]
    items = [(k, " ".join(words(r.randint(8, 40)))) for k in range(25)] + [(100, "rare pair"), (101, None), (102, ""), (103, "Zq"), (100, "rare pair"), (None, "lonely item here")]
    docs = [(k, " ".join(words(30)) + " " + "-".join((items[k % 25][1]).split()[2 : 2 + k % 30]).upper() + " " + " ".join(words(5))) for k in range(80)]
    docs += [(200, "a rare, PAIR rare pair"), (201, None), (202, "zq"), (203, "..."), (204, "lonely item here"), (1, docs[1][1])]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = find(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for d, t in docs:
        w, hit, found = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 as doc_id")
    out = decontaminate.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).drop("items")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    named = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'mine' as bad", "'also' as BAD_")
    clean = decontaminate.without_benchmark(spark, named, bench)
    assert clean.columns == named.columns and {r.bad for r in clean.collect()} == {"mine"}
    assert {r.doc_id for r in clean.collect()} == {d for d, *_, bad in want if not bad}
    assert decontaminate.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).where("contaminated").isEmpty()


def test_decontamination_finds_the_last_words_of_items(spark):
    r = random.Random(5)
    words = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    items = [(k, words(40)) for k in range(150)]
    docs = [(100 * k + n, n, words(20) + w[-n:] + words(3 * (k % 2))) for k, w in items for n in range(9, 16)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    out = decontaminate.decontaminate(spark, spark.createDataFrame([(d, " ".join(w)) for d, _, w in docs], "doc_id long, text string"), bench)
    got = {r.doc_id: (r.n_hit, r.items) for r in out.collect()}
    assert got == {d: (n, [str(d // 100)]) if n >= 10 else (0, []) for d, n, _ in docs}


def test_winnowing_keeps_a_fingerprint_in_every_window():
    grams = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    first = np.array([0, 4, 120, 304])
    kept = decontaminate.fingerprints(first, grams)
    for a, e in zip(first[:-1], first[1:], strict=True):
        for s in range(a, e - 9):
            assert ((kept >= s) & (kept <= s + 5)).any()


def test_encoder_is_the_tokenizer():
    e = packing.Encoder(tokenizer_path())
    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["", " ", "  a", "a  b", "a b ", "x\n y", "x \ny", "　 a", "don't  \n\n x", "<|endoftext|> a", "a<|endoftext|>b <|endoftext|>", "a\tb c", "日本 語", None, "\x1c a", "é x", "👍🏽 ok", "The cat sat, on 12 mats."]
    data, offsets = textkernel.text_bytes(pa.array(texts))
    got = e.encode(data, offsets)
    assert e.core is not None
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark):
    rows = corpus(3, 120)
    out = packing.pack(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), tokenizer_path(), capacity=256).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut(len(ids), 256)):
            want.append((-1 if d is None else d, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
        assert s + n == len(ids)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, out[columns].fillna(-1).astype(int).to_numpy().tolist())) == Counter(want)
    out = out.sort_values(["sequence_id", "offset"])
    group = out.groupby("sequence_id")
    assert (group.length.sum() <= 256).all() and (group.length.cumsum() - out.length == out.offset).all()
    room = []  # first fit, longest first
    for n in sorted(out.length, reverse=True):
        k = next((k for k, left in enumerate(room) if left >= n), None)
        if k is None:
            room.append(256 - n)
        else:
            room[k] -= n
    assert math.ceil(out.length.sum() / 256) <= out.sequence_id.nunique() <= len(room) + 1
    assert packing.pack(spark, spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_plan_places_every_piece():
    h = {n: (n * 7) % 13 + 1 for n in range(3, 200, 5)} | {256: 40, 129: 31}
    made = packing.plan(h, 256)
    used = Counter()
    for items, copies in made:
        assert sum(n * a for n, a in items.items()) <= 256
        for n, a in items.items():
            used[n] += a * copies
    assert used == Counter(h) and packing.plan({}, 256) == []


def naive_lm(rows):
    """Modified Kneser-Ney with plain dictionaries."""
    train = [spaced(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    uni, pair = Counter(), Counter()
    for w in train:
        uni.update([*w, "</s>"])
        pair.update(zip(["<s>", *w], [*w, "</s>"], strict=True))
    before = Counter(b for _, b in pair)
    n, v = sum(uni.values()), len(uni)
    d = lambda c: lm_scoring._discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    low, high = d(before), d(pair)
    types = len(pair)
    total, kinds = Counter(), {}
    for (a, _), c in pair.items():
        total[a] += c
        kinds.setdefault(a, Counter())[min(c, 3)] += 1
    spare = sum(low[min(c, 3)] for c in before.values()) / max(types, 1)

    def p(a, b):
        lower = (before[b] - low[min(before[b], 3)]) / types + spare / (v + 1)
        if not total[a]:
            return lower
        c = pair[a, b]
        return (c - high[min(c, 3)]) / total[a] + sum(high[k] * x for k, x in kinds[a].items()) / total[a] * lower

    out = []
    for doc, t in rows:
        w = spaced(t)
        tokens = [*w, "</s>"]
        score = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], tokens, strict=True))
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in tokens)
        out.append((doc, doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2, len(tokens), sum(uni[x] > 0 for x in tokens), n, base, score))
    vocabulary = [*uni, "never seen"]
    assert sum(p(vocabulary[0], x) for x in vocabulary) == pytest.approx(1)
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 25, 6000])
def test_language_model_equals_dictionaries(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", shard_bytes)
    rows = [(d, t) for d, t, _ in corpus(4, 60)]
    want = sorted(naive_lm(rows), key=str)
    got = sorted(map(tuple, lm_scoring.lm_scores(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    key = lambda x: (str(x[0]), round(x[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-8) and a[6] == pytest.approx(b[6], abs=1e-8)


def test_language_model_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.lm_scores(spark, empty).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = lm_scoring.lm_scores(spark, spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def labelled(n=600):
    r = random.Random(5)
    word = lambda: "".join(r.choices(["ba", "lo", "ti", "re", "mu", "sa"], k=r.randint(1, 4)))
    docs, labels = [], []
    for k in range(n):
        toxic, bad = k % 6 == 0, k % 5 == 1
        w = [word() for _ in range(r.randint(10, 90))]
        if toxic:
            for _ in range(len(w) // 12 + 1):
                w.insert(r.randrange(len(w)), "vequ" + word())
        if bad:
            w = [x.upper() + "!!" for x in w]
        docs.append((k, " ".join(w)))
        labels.append((k, int(not bad), int(toxic)))
    return docs, labels


@pytest.mark.parametrize(("run", "keep", "label", "mod", "out"), [(toxicity.toxicity, toxicity.without_toxic, "toxic", 4, 2), (quality.quality, quality.of_quality, "quality", 5, 0)])
def test_classifiers(spark, run, keep, label, mod, out):
    docs, labels = labelled()
    extra = [(None, "ba lo"), (9000, None), (9001, ""), (9002, "ti " * 5000), (3, docs[3][1])]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "'x' as source", "0 as label", "7 as __quality", "8 as __toxicity", "9 as score")
    l = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), labels[7]], "doc_id long, quality int, toxic int")
    rows = run(spark, d, l).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % mod == out) for x in rows)
    truth = {k: {"quality": q, "toxic": t}[label] for k, q, t in labels}
    held = [x for x in rows if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.93
    kept = keep(spark, d, l)
    assert kept.columns == d.columns
    own = kept.selectExpr("min(__quality)", "max(__quality)", "min(__toxicity)", "max(__toxicity)", "min(score)", "max(score)").first()
    assert tuple(own) == (7, 7, 8, 8, 9, 9)
    assert run(spark, d.limit(0), l).count() == 0
    none = run(spark, d.limit(5), l.limit(0)).collect()
    assert all(x.score == 0.5 for x in none)
