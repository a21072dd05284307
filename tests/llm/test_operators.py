"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import functools
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import bpe_codec, cap_dedup, chunks, class_lm, common, fingerprint, jaccard_join, language_id, mixing, quality, queries, toxicity, url_filter, wordhash
from keyloom.llm.common import fold, prepare
from keyloom.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: A third of the rows are copies of one text.
LONG = " ".join(f"long{i % 977}" for i in range(60_000))


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(40)]
    texts = [None, "", " \t\n", "one", "two words", "Two\x0bWORDS", "ÄÖ ünï cöde", "\U0001f600 ́x", LONG, LONG + " end", "a\nb\n\nc"]
    for b in base:
        texts.append(b)
        words = b.split()
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    texts += [base[0]] * (len(texts) // 2)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "é"][i % 4], None if t is None else len(t), 0.5, 1, True) for i, t in corpus()]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, kept boolean"
    return spark.createDataFrame(rows + [rows[0], rows[12]], names)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def shingles(text, width):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


# Word hashes


def test_word_hashes_follow_words():
    texts = [t for _, t in corpus()]
    _, starts, ends, h, first = wordhash.words(pa.array(texts + ["x"], pa.string()).slice(0, len(texts)))
    seen = {}
    for i, t in enumerate(texts):
        words = WORDS.findall((t or "").translate(LOWER))
        assert first[i + 1] - first[i] == len(words)
        for w, x in zip(words, h[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# 1: URL filters


def glob(pattern, text):
    at = {0}
    for c in pattern:
        if c in "*+":
            at = {j for i in at for j in range(i, 1 + next((k for k in range(i, len(text)) if c == "+" and text[k] == "/"), len(text)))}
        else:
            at = {i + 1 for i in at if i < len(text) and c in ("?", text[i])}
    return len(text) in at


def test_automaton_matches_globs():
    rng = random.Random(1)
    patterns = ["".join(rng.choices("ab/*+?é", k=rng.randint(0, 9))) for _ in range(60)] + ["a" * 200 + "*", "*" + "b" * 130]
    urls = ["".join(rng.choices("ab/é", k=rng.randint(0, 10))) for _ in range(100)] + ["", "a" * 250, "x" + "b" * 130, "ab" * 150]
    for p in patterns:
        got = url_filter.Automaton([url_filter.GlobRule(p, "block")]).match(urls)
        assert [g == 0 for g in got] == [glob(p, u) for u in urls], p
    rules = [url_filter.GlobRule(p, "block", i % 7) for i, p in enumerate(patterns)]
    a = url_filter.Automaton(rules)
    assert a.words > 5
    want = [max((r for r in rules if glob(r.pattern, u)), key=lambda r: r.priority, default=None) for u in urls]
    assert [a.rules[k] if k >= 0 else None for k in a.match(urls)] == want


def test_url_rules(spark):
    prepare(spark)
    urls = [None, "", "no-scheme.com/", "http://EXAMPLE.com/en/1?q", "https://www.example.com/en/", "ftp://x.net/es/a#b", "http://net/fr/", "http://xnet/fr/", "http://com", "http://com/",
            "http://notcom/", "http://a.org/x", "http://spam-farm.org/x.com/", "http://www.example.com/de/", "http://h?://x.com/", "http://m.net/" + "y" * 50_000, "://x.com/", "http://foo.exe"]
    df = spark.createDataFrame([(i, u, "v", "h") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, verdict string, host string")
    got = {r.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in url_filter.judge_urls(df, queries.URL_RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == got[18] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[4][2:] == ("www.example.com/en/", "allow") and got[5] == ("x.net", "/es/a", "net/es/", "block") and got[6][2] == "net/fr/"
    assert got[7][2] is None and got[8] == ("com", "", None, "allow") and got[9][2] == "com/" and got[10][2] is None and got[11][2:] == (None, "allow")
    assert got[12][2:] == (None, "block") and got[13][2] == "com/" and got[14][:2] == ("h", "") and got[15][2] is None and got[16][2] == "com/"
    assert got[17][2:] == (None, "allow")  # a host is no file
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


# 2 and 10: classifiers


def labelled(spark):
    rng = random.Random(2)
    clean = ["the", "of", "and", "river", "house", "light", "green", "walk"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(clean, k=60)
        toxic, bad = i % 6 == 0, i % 5 == 1
        if toxic:
            for w in rng.sample(["vilefoo", "vilebar", "nastyx", "grimzz"], 2):
                words[rng.randrange(60)] = w
        lines = [" ".join(words[j : j + 10]) for j in range(0, 60, 10)]
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    edge = [(10_000, None), (10_001, ""), (10_002, "   "), (10_003, LONG), (10_003, LONG), (10_004, "THE vilefoo, Vilebar!")]
    return spark.createDataFrame(rows + edge, "doc_id long, text string"), spark.createDataFrame(labels + [(10_000, None, 1), (None, 1, 0), (99_999, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_held_out_rows(spark, module, column):
    prepare(spark)
    docs, labels = labelled(spark)
    model = module.train(docs, labels)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    truth = {r.doc_id: r[column] for r in labels.collect() if r.doc_id is not None and r.doc_id < 600}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(truth[i]) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 605 and got[10_000] == got[10_001] == got[10_002]
    if column == "toxic":
        assert got[10_004] > 0.5 > got[10_003]
    again = module.train(docs.repartition(7), labels.repartition(3))
    assert np.allclose([r.score for r in module.score(docs.where("doc_id < 50").orderBy("doc_id"), again).collect()], [got[i] for i in range(50)], atol=1e-6)
    empty = module.train(docs, labels.limit(0))
    assert {r.score for r in module.score(docs, empty).collect()} == {0.0 if column == "toxic" else 1.0}
    assert module.score(docs.limit(0), model).count() == 0


def test_labelled_sample_is_bounded_in_rows(spark):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"t{i} v{j % 3}") for i in ids for j in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, y int")
    got = common.labelled_sample(docs, labels, "y", 100).collect()
    assert len(got) == 100 == len({r.text for r in got})
    assert common.labelled_sample(docs, labels, "y", 10**6).count() == 3 * len(ids)
    rest = common.unlabelled_sample(docs, labels.where("doc_id < 500"), "y", 50).collect()
    assert 0 < len(rest) <= 50 and all(int(r.text[1:].split()[0]) >= 500 for r in rest)


def test_votes_and_samples_are_of_whole_texts(spark):
    """What tells stands behind a beginning without any capital, as long as one step of texts."""
    quiet = "quiet words " * 20
    model = toxicity.ToxicityModel([("vilefoo", True, 1)])
    loud = dict(zip(toxicity.PATTERNS, model.votes(quiet + "LOUD ÉÀ " * 100)[1:], strict=True))
    assert loud["shouted"] == 1 and model.votes(quiet + "LOUD ")[-1] == 0 == model.votes(quiet.upper() + 10 * quiet)[-1]
    whole = quiet * 5000 + "you vilefoo!! v*le"
    assert model.votes(whole)[0] == 1
    docs = spark.createDataFrame([(i, f"{whole} {i}") for i in range(20)], "doc_id long, text string")
    kept = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5]
    rest = common.unlabelled_sample(docs, docs.select("doc_id", F.lit(1).alias("y")).where("doc_id < 10"), "y", 50).collect()
    assert sorted(r.text for r in rest) == sorted(f"{whole} {i}" for i in kept if i >= 10)


def test_label_model_estimates_voters():
    """Votes of known accuracy, two of them one voter twice, and labels of which a tenth is wrong."""
    rng = np.random.default_rng(4)
    truth = rng.random(8000) < 0.2
    says = lambda hit, miss: np.where(rng.random(8000) < np.where(truth, hit, miss), 1, 0)
    votes = np.column_stack([v := says(0.8, 0.02), v, says(0.6, 0.05), says(0.7, 0.01), says(0.1, 0.1)]).astype(np.int8)
    label = np.where(rng.random(8000) < 0.5, np.where(truth ^ (rng.random(8000) < 0.1), 1, -1), 0)
    post, p, right = toxicity.label_model(votes, label)
    assert np.allclose(p[1, 2], [0.8, 0.8, 0.6, 0.7, 0.1], atol=0.06) and np.allclose(p[0, 2], [0.02, 0.02, 0.05, 0.01, 0.1], atol=0.03)
    assert abs(right[1] - 0.9) < 0.05 and abs(right[0] - 0.1) < 0.03
    assert np.mean((post > 0.5) == truth) > 0.95


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 4, 3, 0, 6]
    first = np.concatenate(([0], np.cumsum(sizes)))
    unary, pair = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    good, expected, log_z = quality.forward_backward(unary, pair, first)
    total = np.zeros((2, 2))
    for c, n in enumerate(sizes):
        u = unary[first[c] : first[c + 1]]
        weights = {}
        for labels in np.ndindex(*[2] * n):
            weights[labels] = math.exp(sum(u[i] * y for i, y in enumerate(labels)) + sum(pair[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weights.values())
        if n:
            assert math.isclose(log_z[c], math.log(z))
        for i in range(n):
            assert math.isclose(good[first[c] + i], sum(w for y, w in weights.items() if y[i]) / z)
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                total[a, b] += w / z
    assert np.allclose(total, expected)


# 3: fingerprints


def test_fingerprints(docs, none):
    rows = sorted(texts_of(docs), key=lambda r: (-r[0], r[1] or ""))
    out = defaultdict(list)
    for r in fingerprint.fingerprint_pairs(docs).collect():
        out[r.doc_id].append(r)
    by_text = {}
    for i, (key, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        found = [r for r in out[key] if r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert found, key
        assert by_text.setdefault(t, found[0].fingerprint) == found[0].fingerprint
        assert 0 <= found[0].near_next <= 1 and (t != nxt or found[0].near_next == 1) and (edited != t or found[0].near_edited == 1)
    assert sum(map(len, out.values())) == len(rows) and fingerprint.fingerprint_pairs(none).count() == 0


def test_near_copies_of_short_texts_compare_exactly(spark):
    sizes = [6, 7, 10, 20, 28, 60]
    texts = [" ".join(f"{n}w{i}" for i in range(n)) for n in sizes]
    df = spark.createDataFrame([(n, t, t + " more", t + " long" * 100) for n, t in zip(sizes, texts, strict=True)], "n int, a string, b string, c string")
    a, b, c = (fingerprint.sketch(F.col(x)) for x in "abc")
    for r in df.select("n", fingerprint.likeness(a, b).alias("j"), fingerprint.containment(a, b).alias("held"), fingerprint.containment(a, c).alias("in_long"), c["all"].alias("all")).collect():
        assert r.j == pytest.approx((r.n - 4) / (r.n - 3)) and r.held == 1.0 and r.in_long in (None, 1.0) and not r.all


def brute_sketch(text):
    """(hash of all words, kept hashes, whether all are kept)."""
    hashed = lambda parts: functools.reduce(lambda seed, b: xxhash.xxh64_intdigest(b, seed), parts, 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [signed(hashed([w.encode()])) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    packed = [struct.pack("<q", h) for h in words]
    shingles = [signed(hashed(packed[i : i + 5])) for i in range(len(words) - 4)] if len(words) >= 5 else [signed(hashed(packed))] if words else []
    every = len(words) - 4 <= fingerprint.ALL
    return signed(hashed(packed)), {x for x in shingles if every or x < -(1 << 63) + (1 << 64) // fingerprint.SCALE}, every


def test_likeness_by_brute_force(docs):
    low = -(1 << 63) + (1 << 64) // fingerprint.SCALE
    rows = sorted(texts_of(docs.dropDuplicates(["doc_id"])), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprint_pairs(docs.dropDuplicates(["doc_id"])).collect()}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        for other, value in ((t[: len(t) - half] + after[:half], got[i].near_edited), (after, got[i].near_next)):
            (wa, a, all_a), (wb, b, all_b) = brute_sketch(t), brute_sketch(other)
            a, b = {x for x in a if all_b or x < low}, {x for x in b if all_a or x < low}
            want = 1.0 if wa == wb else len(a & b) / len(a | b) if a | b else 0.0
            assert value == pytest.approx(want), i


def test_string_keys_are_refused_in_words(spark):
    with pytest.raises(TypeError, match="needs a number"):
        fingerprint.fingerprint_pairs(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_sketches_estimate_and_merge(spark):
    import xxhash

    words = [f"t{i}" for i in range(4000)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:500]))], "i int, text string").select("i", fingerprint.sketch(F.col("text")).alias("s"))
    a, b = [r.s for r in df.orderBy("i").collect()]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    assert len(a.kept) == pytest.approx(4000 / fingerprint.SCALE, rel=0.2) and set(b.kept) <= set(a.kept) and h
    merged = df.agg(F.collect_list("s.kept").alias("k")).select(fingerprint.merge(F.col("k")).alias("m")).first().m
    assert merged == a.kept
    both = df.alias("x").join(df.alias("y"), F.expr("x.i = 1 and y.i = 0")).select(fingerprint.containment(F.col("x.s"), F.col("y.s")).alias("c"), fingerprint.likeness(F.col("x.s"), F.col("y.s")).alias("j")).first()
    assert both.c == 1.0 and both.j == pytest.approx(0.125, abs=0.05)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_next_row_over_ranges(spark, ranges):
    keys = [5, 5, None, 9, 1, 7, 7, -3, 100, 42]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "key long, text string")
    order = sorted(((k is None, -(k or 0), t) for k, t in ((r.key, r.text) for r in df.collect())))
    want = sorted((order[i][2], order[(i + 1) % len(order)][2]) for i in range(len(order)))
    assert sorted((r.text, r.next.text) for r in fingerprint.with_next(df, "key", ["text"], "text", ranges).collect()) == want


# 4: mixing


def test_mix(docs, none):
    rows = mixing.mix_sources(docs).collect()
    size = {i: len(WORDS.findall(t or "")) for i, t in texts_of(docs)}
    total, by = sum(r.size for r in rows), defaultdict(list)
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    for s, found in by.items():
        assert {r.source_size for r in found} == {sum(r.size for r in found)}
        assert abs(sum(r.taken for r in found) - found[0].target) <= 0.5 and found[0].target <= 3 * found[0].source_size
    assert math.isclose(sum(found[0].target for found in by.values()), total)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken, r.source or "")
    assert sorted(map(key, rows)) == sorted(map(key, again)) and mixing.mix_sources(none).count() == 0


def filled(sizes, weights, most):
    """Targets by brute force: share by weight, fix the sources above their cap, and share what is left again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free = {}, set(names)
    while free:
        level = (sum(sizes.values()) - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        out |= {s: float(most * sizes[s]) for s in over} if over else {s: weight[s] * level for s in free}
        free = free - over if over else set()
    return out


@pytest.mark.parametrize("case", ["few", "many", "equal", "no words", "none"])
def test_targets_share_what_caps_free(spark, case):
    rng = random.Random(6)
    sizes = {
        "few": {"b": 100, "a": 1000, None: 10, "c": 0}, "many": {f"s{i}\u00e9\U0001f600"[: rng.randint(2, 9)] + str(i): int(10 ** rng.uniform(0, 7)) for i in range(500)} | {None: 5, "": 7},
        "equal": {f"s{i}": 10 for i in range(20)}, "no words": {"a": 0, None: 0}, "none": {},
    }[case]
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "src string, source_size long, n long").repartition(3)
    for weights, most in (((1, 2, 3), 3), ((5.0, 1.0), 2)):
        rows, want = mixing.targets(df, weights, most).collect(), filled(sizes, weights, most)
        assert sorted(r.sid for r in rows) == list(range(len(sizes)))
        assert [r.src for r in sorted(rows, key=lambda r: r.sid)] == sorted(sizes, key=lambda s: (s is None, s or ""))
        assert {r.src: r.target for r in rows} == pytest.approx(want) and all(r.source_size == sizes[r.src] for r in rows)


def test_mix_with_sources_too_many_to_broadcast(docs, monkeypatch):
    key = lambda r: (r.doc_id, r.taken, r.source or "", r.target)
    rows = sorted(map(key, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert sorted(map(key, mixing.mix_sources(docs).collect())) == rows


def test_mixed_copies_hold_what_the_mix_takes(docs):
    plain = docs.dropDuplicates(["doc_id"])
    mix = mixing.mix_sources(plain)
    out = mixing.mixed_copies(plain, mix)
    assert out.columns == plain.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORDS.findall(r.text or ""))
    assert got == Counter({r.doc_id: r.taken for r in mix.collect() if r.taken})


@pytest.mark.parametrize("seed", ["mix-1:", "other:", "third:"])
def test_mixed_copies_of_repeated_rows(spark, seed):
    """Equal ids and texts in two sources, rows repeated in one, null ids and columns with names of the operator's own."""
    text = "one two three"
    rows = [(1, text, "a", 1), (1, text, "b", 2), (2, text, "a", 3), (2, text, "a", 4), (2, text, "a", 5), (None, text, "b", 6), (None, text, "b", 6), (None, "x y", None, 7), (3, None, "b", 8), (4, "", "a", 9), (5, "w " * 40, "b", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __t long").withColumns({"cut": F.lit("c"), "mix_k": F.lit("k"), "size": F.lit(-1)})
    mix = mixing.mix_sources(docs, seed=seed)
    out = mixing.mixed_copies(docs, mix)
    assert out.columns == docs.columns
    rows_of = out.collect()
    got = Counter()
    for r in rows_of:
        got[r.doc_id, r.source] += len(WORDS.findall(r.text or ""))
    want = Counter()
    for r in mix.collect():
        want[r.doc_id, r.source] += r.taken
    assert +got == +want
    assert {(r.doc_id, r.source, r["__t"]) for r in rows_of} <= {(a, c, d) for a, _, c, d in rows} and all(r.cut == "c" and r.size == -1 for r in rows_of)


# 5: language ID


def test_language_id(spark, docs, none):
    prepare(spark)
    rng = random.Random(4)
    words = {"aa": ["walrus", "harbor", "thinking", "weather"], "bb": ["größe", "straße", "können", "wetter"], "cc": ["ñandú", "también", "corazón", "lluvia"]}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(3, 80))), k) for i in range(300) for k in [list(words)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, where=fold("doc_id") != 0)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows]) > 0.98
    assert model.predict("walrus harbor " * 40_000)[0] == "aa" and not model.predict("walrus harbor weather")[3]
    for t in (None, "", "123 !?", "½ ²"):
        assert model.predict(t) == ("und", 0.0, 0.0, True)
    assert language_id.identify(none, model).count() == 0 and language_id.identify(docs, model).count() == docs.count()
    nothing = language_id.train(df.limit(0))
    assert nothing.predict("walrus")[0] == "und"
    one = language_id.train(df.where("lang = 'aa'"))
    assert one.predict("walrus")[:1] == ("aa",)


def test_language_is_learned_from_whole_texts(spark):
    """Every text of the sample enters the dictionary, with a piece from anywhere in it."""
    words = {"en": "the house with that which from this", "de": "das haus mit dem welches von diesem"}
    texts = [(k, "1 2 3 " * 400 + f"{w} {'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10] * 3} " * (1 + i * 5)) for k, w in words.items() for i in range(100)]
    model = language_id.train(spark.createDataFrame(texts, "lang string, text string"))
    assert set(model.dictionaries) == set(words) and all(len(d) <= language_id.DICT_BYTES for d in model.dictionaries.values())
    assert all(len(set(re.findall(rb"([a-j])\1\1([k-t])\2\2", d))) >= 95 for d in model.dictionaries.values())
    assert [model.predict(w)[0] for w in words.values()] == list(words)


def test_a_language_of_one_repeated_text_is_learned(spark):
    prepare(spark)
    rows = [("ein Haus am Fluss und viele Worte darin " * 3, "xx")] * 3000 + [(f"some other words number {i} " * 3, "yy") for i in range(50)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.train(df)
    assert set(model.dictionaries) == {"xx", "yy"} and len(model.dictionaries["xx"]) < 500
    assert model.predict("viele Worte am Fluss")[0] == "xx" and model.predict("number words")[0] == "yy"


def test_language_sizes_by_brute_force(spark, docs):
    """The smallest sum of compressed blocks wins."""
    import zstandard

    prepare(spark)
    rows = [(f"alpha beta gamma {i} delta " * 5, "a") for i in range(30)] + [(f"eins zwei drei {i} vier " * 5, "b") for i in range(30)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    for t in ("alpha gamma zwei delta beta alpha " * 120, "drei vier " * 900 + "alpha"):
        sizes = {}
        for k, d in model.dictionaries.items():
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[k] = sum(len(c.compress(b.encode())) for b in language_id.blocks(language_id.normalise(t)))
        assert model.predict(t)[0] == min(sizes, key=lambda k: (sizes[k], k))


# 6: Jaccard join


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        low[find(i)].append(key)
    return sorted((key, len(sets[i]), min(low[find(i)])) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 90, 1024), (5, 80, 1024), (2, 60, 4), (1, 100, 2)])
def test_jaccard(docs, none, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = texts_of(docs)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, width=width, percent=percent).collect())
    assert got == brute_components(rows, width, percent)
    if block == 1024:
        assert jaccard_join.jaccard_components(none, width=width, percent=percent).count() == 0


def test_jaccard_repeated_ids(spark):
    """Rows of one id with different texts are in one component; rows without an id link nothing."""
    prepare(spark)
    rng = random.Random(3)
    base = [rng.choices([f"w{i}" for i in range(400)], k=60) for _ in range(10)]
    rows = []
    for _ in range(80):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(60)] = "edit"
        rows.append((rng.randrange(50), " ".join(words)))
    rows += rows[:15]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    nodes = [(i, shingles(t, 3)) for i, t in rows]
    for n, (i, a) in enumerate(nodes):
        for m, (j, b) in enumerate(nodes[:n]):
            if i == j or 100 * len(a & b) >= 90 * len(a | b):
                root[find(n)] = find(m)
    low = defaultdict(list)
    for n, (i, _) in enumerate(nodes):
        low[find(n)].append(i)
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "all alone here today")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df, width=3, percent=90).collect() if r.doc_id is not None)
    assert got == sorted((i, min(low[find(n)])) for n, (i, _) in enumerate(nodes))


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(1000, i) for i in range(900, 1000)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*pairs, (None, 1), (7, 7)], "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    for v in got:
        seen, todo = {v}, [v]
        while todo:
            for u in near[todo.pop()] - seen:
                seen.add(u), todo.append(u)
        assert got[v] == min(seen)


# 7: language model


def test_language_model(docs, none):
    rows = texts_of(docs)
    out = defaultdict(list)
    for r in class_lm.score_documents(docs, fold("doc_id") != 1).collect():
        out[r.doc_id].append(r)
    tokens = [(i, [*WORDS.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert any(r.n_tokens == len(ws) and r.n_known == sum(c[w] > 0 for w in ws) and r.train_tokens == n and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 for r in out[i])
    assert sum(map(len, out.values())) == len(rows) and class_lm.score_documents(none, fold("doc_id") != 1).count() == 0


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    pairs = np.zeros((41, 41))
    for _ in range(20_000):  # even words follow odd ones
        a = rng.integers(0, 20) * 2
        pairs[a, rng.integers(0, 20) * 2 + 1] += 1
        pairs[rng.integers(0, 20) * 2 + 1, a] += 1
    cls = class_lm.exchange(pairs, 40, 2, 20)
    assert len(set(cls[:40:2])) == len(set(cls[1:40:2])) == 1 and cls[0] != cls[1] and cls[40] == 2


def test_best_classes_raise_the_likelihood_most():
    rng = np.random.default_rng(0)
    words, classes = 12, 5
    pairs, cls = rng.integers(0, 4, (words, words)).astype(float), rng.integers(0, classes, words)
    member = lambda k: np.eye(classes)[k]
    value = lambda k: class_lm.likelihood(member(k).T @ pairs @ member(k))
    after, before, twice = pairs @ member(cls), pairs.T @ member(cls), np.diag(pairs)
    after[np.arange(words), cls] -= twice
    before[np.arange(words), cls] -= twice
    got = class_lm.best_classes(member(cls).T @ pairs @ member(cls), cls, np.column_stack((after, before, twice)), classes)
    for w in range(words):
        of = [value(np.where(np.arange(words) == w, b, cls)) for b in range(classes)]
        assert of[got[w]] == pytest.approx(max(of))


def test_rare_words_are_clustered_too(spark):
    """Words of two kinds take turns; there are more than the frequent ones, all about as frequent."""
    rng, kinds = random.Random(5), class_lm.FREQUENT * 2
    texts = [" ".join(f"{'ab'[i % 2]}{rng.randrange(kinds)}" for i in range(60)) for _ in range(1000)]
    prepare(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = class_lm.score_documents(df, F.lit(True)).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    # Knowing the kind halves the choice: log10(2) a token.
    assert r[0] - r[1] > 0.25 * r[2]


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


def test_scores_are_those_of_the_classes(spark, monkeypatch):
    """The model's scores from the classes it found, by brute force; the probabilities of all words after a class make one."""
    prepare(spark)
    monkeypatch.setattr(chunks, "CHUNK_TOKENS", 300)  # a word is in many chunks
    kept = {}
    cluster = class_lm._cluster

    def spy(texts, words, counted, rounds):
        state, n = cluster(texts, words, counted, rounds)
        kept["n"] = n
        kept["classes"] = class_lm._answers(words, state, "u1", with_counts=True).collect()
        kept["hashes"] = words.select("bucket", "a", "c").collect()
        return state, n

    monkeypatch.setattr(class_lm, "_cluster", spy)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(120)] + [(1000, None), (1001, "w1 new words w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in class_lm.score_documents(docs, F.col("doc_id") < 100).collect()}
    class_of, count_of = {}, {}
    for r in kept["hashes"]:
        a = next(x for x in kept["classes"] if x.place == chunks.chunk_of(r.c) and x.bucket == r.bucket)
        for h, k, c in zip(np.cumsum(chunks.unpack(r.a, "<u8"), dtype=np.uint64), chunks.unpack(a.a, "u1"), chunks.unpack(a.b, "<i8"), strict=True):
            class_of[int(h)], count_of[int(h)] = int(k) & 127, int(c)
    name = {w: int(wordhash.words(pa.array([w], pa.string()))[3][0]) for _, t in rows for w in words_of(t)}
    train = [words_of(t) for i, t in rows if i < 100]
    counts = Counter(w for ws in train for w in ws)
    assert all(count_of[name[w]] == counts[w] for w in name)
    end, unseen = class_lm._END_CLASS, class_lm._UNSEEN
    cls = {w: class_of[name[w]] if counts[w] else unseen for w in name}
    assert all(k < class_lm.CLASSES for w, k in cls.items() if counts[w])
    n = np.zeros_like(kept["n"])
    for ws in train:
        seq = [None, *ws, None]
        for p, q in zip(seq[:-1], seq[1:], strict=True):
            cp, cq = (end if x is None else cls[x] for x in (p, q))
            n[cp, cq] += 1
            n[unseen, cq] += p is not None and counts[p] == 1
            n[cp, unseen] += q is not None and counts[q] == 1
    assert (n == kept["n"]).all()
    mass = n[:unseen, :unseen].sum(0)
    logp = class_lm._transition(n)
    for i, t in rows:
        seq, want = [None, *words_of(t), None], 0.0
        for p, q in zip(seq[:-1], seq[1:], strict=True):
            cp, cq = (end if x is None else cls[x] for x in (p, q))
            want += logp[cp, cq] + (0 if q is None or not counts[q] else math.log10(counts[q] / mass[cq]))
        assert math.isclose(got[i].score, want, rel_tol=1e-9)
    for k in {*cls.values(), end, unseen}:
        total = sum(10 ** logp[k, cls[w]] * counts[w] / mass[cls[w]] for w in counts) + 10 ** logp[k, end] + 10 ** logp[k, unseen]
        assert math.isclose(total, 1.0, rel_tol=1e-9)


# 8: BPE


def test_bpe_is_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    prepare(spark)
    spec = queries.vocabulary()
    library = Tokenizer.from_str(spec)
    rng = random.Random(8)
    signs = "aAbZ'sdtlm019 \t\n\x1c\x85\xa0ÉéßΣσςİıǅ日本ل́̇½²_-!?<|>​　\U0001f600ﬁ"
    split, encoder = bpe_codec.Splitter(spec), bpe_codec.Encoder(spec)
    fuzz = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(2000)] + ["".join(rng.choices("'strevmldST'1!\xe9 ", k=rng.randint(0, 12))) for _ in range(3000)]
    fuzz += ["<|startoftext|>it's<|endoftext|>", "<|ENDOFTEXT|>", "ΑΣ ΑΣ.", None, "", "'", "a'", "'l", "'ll", "!'s", "'s's", "''re"]
    rng.shuffle(fuzz)
    for at in (0, 100, 1000, 1003):  # steps of texts of several sizes
        part = fuzz[at : at + 1500]
        found, sizes = split(pa.array(["x", *part], pa.string()).slice(1))
        words, ends = found.to_pylist(), np.concatenate(([0], np.cumsum(sizes)))
        for t, i, j in zip(part, ends[:-1], ends[1:], strict=True):
            got = np.frombuffer(b"".join(encoder(words[i:j])), "<i4").tolist()
            assert got == library.encode(t or "", add_special_tokens=False).ids, t
    digests = {r.doc_id: r for r in bpe_codec.encode_digests(docs, spec).collect()}
    encoded = bpe_codec.encode(docs, spec)
    decoded = {r.doc_id: r.text for r in bpe_codec.decode(encoded, spec).collect()}
    for key, t in texts_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = digests[key]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and decoded[key] == text
    assert bpe_codec.encode_digests(none, spec).count() == bpe_codec.encode(none, spec).count() == 0


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    """Over small chunks, a word of all texts is still one entry of one task's table."""
    prepare(spark)
    monkeypatch.setattr(chunks, "CHUNK_TOKENS", 20)
    spec = queries.vocabulary()
    docs = spark.createDataFrame([(i, f"shared words of all texts and one own w{i} it's <|endoftext|>") for i in range(60)], "doc_id long, text string").repartition(5)
    library = bpe_codec.Encoder(spec).model
    got = {r.doc_id: r.ids for r in bpe_codec.encode(docs, spec).collect()}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(spec)
    assert library.get_vocab_size() <= whole.get_vocab_size()
    assert all(got[i] == whole.encode(t, add_special_tokens=False).ids for i, t in texts_of(docs)) and len(got) == 60
    plan = bpe_codec.encode(docs, spec)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroupsInArrow" in plan


def test_words_of_a_chunk_take_little_memory():
    """While a chunk is gathered, a word takes four bytes besides its step's distinct words, and numbering makes no copy of the words."""
    spec = queries.vocabulary()
    split = bpe_codec.Splitter(spec)
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"], k=100_000)) for _ in range(8)] + [None, "", "it's 12 \u00e9\u0301!"]
    pool = pa.default_memory_pool()
    before = pool.bytes_allocated()
    steps, sizes = zip(*(bpe_codec._coded(pa.array([t], pa.string()), split) for t in texts), strict=True)
    n = sum(int(s.sum()) for s in sizes)
    assert n > 800_000 and pool.bytes_allocated() - before < 5 * n
    numbers, edges, blobs = bpe_codec._number(list(steps), np.zeros(n, np.uint8), 7)
    words: list[str] = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        lens, body = blobs(i, j)
        ends = bpe_codec._ends(chunks.unpack(lens))
        words += [chunks.expand(body)[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert len(set(words)) == len(words) == edges[-1] and [words[i] for i in numbers] == [w for t in texts for w in split.one(t or "")]


def test_decoding_skips_unknown_ids(spark):
    prepare(spark)
    spec = queries.vocabulary()
    df = spark.createDataFrame([(1, [320, -5, 10**6, 321]), (2, []), (3, None)], "doc_id int, ids array<int>")
    piece = bpe_codec.id_to_piece(__import__("json").loads(spec))
    assert {r.doc_id: r.text for r in bpe_codec.decode(df, spec).collect()} == {1: f"{piece[320]} {piece[321]}", 2: "", 3: None}


# 9: vectors


@pytest.mark.parametrize("codes", [256, 1024])
@pytest.mark.parametrize("dim", [1, 2, 3, 8, 12, 13, 16, 24, 64])
def test_linked_vectors_share_a_filter(dim, codes):
    """Pairs at the least cosine, the hardest to catch."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((300, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    y = x if dim == 1 else 0.98 * x + math.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    shared = [bool(set(f) & set(g)) for f, g in zip(cap_dedup.filters_of(x, codes), cap_dedup.filters_of(y, codes), strict=True)]
    assert np.mean(shared) >= (1.0 if dim <= cap_dedup.FEW else 0.93)


def test_string_ids_of_vectors(spark):
    prepare(spark)
    df = spark.createDataFrame([("b", [1.0, 0.0], 1), ("a", [1.0, 0.01], 1), ("c", [0.0, 1.0], 1)], "vec_id string, embedding array<double>, label int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in cap_dedup.dedup_vectors(df).collect()} == {("b", 1, "a"), ("a", 1, "a"), ("c", 0, "c")}


@pytest.mark.parametrize("block", [1024, 3])
def test_vectors(spark, monkeypatch, block):
    prepare(spark)
    monkeypatch.setattr(cap_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(120)]
    for g in range(12):
        v = np.array(rows[g][1])
        rows += [(len(rows) + k, (v * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.uniform(0.02, 0.25)).tolist(), rows[g][2]) for k in range(6)]
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(8)]  # copies
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, None] * 8, 0), (n + 3, [math.nan] * 16, 0), (n + 4, rows[0][1], None), (n + 5, [], 0), (n + 6, [math.inf] * 16, 0), (n + 7, [1.0], 0), (n + 8, rows[0][1], 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, kept string")

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]) or None in a[1] or None in b[1]:
            return False
        x, y = np.array(a[1]), np.array(b[1])
        with np.errstate(all="ignore"):
            return bool(np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98)

    near = {a[0]: {b[0] for b in rows if b is not a and linked(a, b)} for a in rows}
    got = {r.vec_id: r for r in cap_dedup.dedup_vectors(df).collect()}
    assert len(got) == len(rows)
    found, total = sum(r.n_links for r in got.values()), sum(map(len, near.values()))
    assert total > 300 and 0.97 * total <= found <= total
    for v in got:
        seen, todo = {v}, [v]
        while todo:
            for u in near[todo.pop()] - seen:
                seen.add(u), todo.append(u)
        assert got[v].component_id in seen and got[v].kept == (got[v].component_id == v) and got[v].n_links <= len(near[v])
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(n, n + 9))
    assert cap_dedup.dedup_vectors(df.limit(0)).count() == 0
