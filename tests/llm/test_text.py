"""Operators on texts: brute force, round trips, held-out accuracy, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import time
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeline.llm import bpe, jaccard, language, mixing, quality, toxicity
from spokeline.llm.queries import vocabulary_path

WORDS = {"en": "the and of thing when water house is to a be from", "de": "der und die nicht ist wasser haus von zu ein über schön", "fr": "le et les une eau maison être dans pour avec été où"}


def prose(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "er", "s", "t"]) for _ in range(n))


ODD = [(None, None, None, None), (900, None, None, "src"), (901, "", "en", None), (902, " \t\n", "en", ""), (903, "12 34 !!", "en", "a"), (904, "x" * 5000, None, "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, prose(lang, rng.randint(30, 90), rng), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += ODD + [rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    for clash in ("n_tokens", "size", "score", "held_out", "key", "kept_id", "shard", "label", "n_chars"):
        df = df.withColumn(clash, F.lit("clash"))
    return df.cache()


def counts_ids(df, corpus):
    assert sorted(map(str, (r["doc_id"] for r in df.select("doc_id").collect()))) == sorted(map(str, (r["doc_id"] for r in corpus.select("doc_id").collect())))


def test_language(spark, corpus):
    out = language.identify(corpus)
    counts_ids(out, corpus)
    got = {r["doc_id"]: r for r in out.collect()}
    true = {r["doc_id"]: r["lang"] for r in corpus.where("doc_id < 900").collect()}
    held = [i for i in true if got[i]["held_out"]]
    assert held and all(got[i]["lang_pred"] == true[i] for i in held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(corpus.limit(0)).count() == 0
    assert language.keep(corpus).where("doc_id in (900, 901, 902, 903) or doc_id is null").count() == 0
    assert language.keep(corpus).columns == corpus.columns


def test_language_bundle_is_the_sum_of_bound_vectors():
    v = language.letter_vectors().astype(int)
    s = [0, 1, 2, 3, 0]  # " abc "
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(s, s[1:], s[2:]))
    got, n = language.bundles(["abc"])
    assert (got[0] == want).all() and n[0] == 3


def test_language_of_each_text_by_definition(spark, corpus):
    """Predictions against a second way: vectors bound and added one gram at a time."""
    v = language.letter_vectors().astype(np.float64)
    slot = toxicity.slots()

    def bundle(text):
        s = [int(slot[ord(c)]) for c in f" {text} "]
        grams = [(a, b, c) for a, b, c in zip(s, s[1:], s[2:]) if a or b or c]
        return sum((np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in grams), np.zeros(language.DIMS)), len(grams)

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in corpus.collect()]
    protos = {}
    for (i, text, lang), held in zip(rows, [r["held_out"] for r in language.identify(corpus).collect()], strict=True):
        total, n = bundle(text or "")
        if not held and lang and n:
            protos[lang] = protos.get(lang, 0) + total / n
    names = sorted(protos)
    p = np.stack([protos[k] / np.linalg.norm(protos[k]) for k in names])
    for r in language.identify(corpus).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        total, n = bundle(text or "")
        if n:
            cos = p @ total / max(np.linalg.norm(total), 1e-30)
            assert r["lang_pred"] == names[int(cos.argmax())] and r["score"] == pytest.approx(max(0.0, cos.max()), abs=1e-4)


def test_language_stage_drops_what_is_in_no_learned_language(spark, corpus):
    rng = random.Random(31)
    strange = [(3000 + i, " ".join("".join(rng.choice("ąćęłńśźżqxvwyzkj") for _ in range(rng.randint(3, 9))) for _ in range(60)), None, "x") for i in range(20)]
    both = corpus.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(strange, SCHEMA))
    kept = {r["doc_id"] for r in language.keep(both).collect()}
    assert not any(i in kept for i in range(3000, 3020)) and all(i in kept for i in range(120))


def test_quality(spark, corpus):
    rng = random.Random(5)
    junk = spark.createDataFrame([(1000 + i, " ".join(w + "$$$" for w in prose("en", 40, rng).split()), "en", "s0") for i in range(60)], SCHEMA)
    both = corpus.select(SCHEMA.replace(" long", "").replace(" string", "").split(", ")).union(junk)
    labels = both.where("doc_id is not null").select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality")).distinct()
    out = quality.classify(both, labels)
    counts_ids(out, both)
    rows = out.collect()
    right = [(r["doc_id"] < 1000) == bool(r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] is not None and (r["doc_id"] < 900 or r["doc_id"] >= 1000)]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep(both, labels)
    assert kept.where("doc_id < 900").count() >= 118 and kept.where("doc_id >= 1000").count() <= 3
    assert {r["score"] for r in quality.classify(both, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(both.limit(0), labels).count() == 0


def test_quality_cosines_are_exact():
    rng = np.random.default_rng(1)
    model = {"idf": np.ones(quality.TERMS, np.float32), "axes": rng.standard_normal((quality.TERMS, 8)).astype(np.float32), "vectors": quality.unit(rng.standard_normal((40, 8))).astype(np.float32), "labels": rng.integers(0, 2, 40).astype(float), "prior": 0.5}
    text = "one two, three THREE"
    z = quality.unit(quality.unit(np.log1p(quality.term_counts(text))[None]) @ model["axes"])[0]
    cos = model["vectors"] @ z
    top = np.argsort(-cos)[: quality.NEIGHBOURS]
    w = np.maximum(cos[top], 0)
    assert quality.votes([text], model)[0] == pytest.approx((w * model["labels"][top]).sum() / w.sum(), abs=1e-5)


def test_quality_ties_go_to_the_smaller_doc_id():
    rng = np.random.default_rng(2)
    for _ in range(50):
        few = quality.unit(rng.standard_normal((6, 8))).astype(np.float32)
        model = {"idf": np.ones(quality.TERMS, np.float32), "axes": rng.standard_normal((quality.TERMS, 8)).astype(np.float32), "vectors": few[rng.integers(0, 6, 90)], "labels": rng.integers(0, 2, 90).astype(float), "prior": 0.5}
        z = quality.unit(quality.unit(np.log1p(quality.term_counts("one two, three THREE"))[None]) @ model["axes"])[0]
        cos = np.round(model["vectors"].astype(float) @ z.astype(float), 9)
        top = np.lexsort((np.arange(90), -cos))[: quality.NEIGHBOURS]
        w = np.maximum(cos[top], 0)
        want = (w * model["labels"][top]).sum() / w.sum() if w.sum() else 0.5
        assert quality.votes(["one two, three THREE"], model)[0] == pytest.approx(want, abs=1e-9)


def model_of(text):
    counts = np.bincount(toxicity.codes(text), minlength=toxicity.GRAMS).reshape(64, 64, 64) + 0.01
    return (-np.log(counts / counts.sum(axis=2, keepdims=True))).astype(np.float32)


def test_viterbi_is_the_best_reading():
    cost = model_of("idiot moron trash the water house " * 50)
    slot = toxicity.slots()

    def brute(span):
        best = (1e18, "")

        def go(i, a, b, total, text):
            nonlocal best
            if i == len(span):
                best = min(best, (total + float(cost[a, b, 0]), text))
                return
            for c, channel in toxicity.readings(span[i]):
                if not c:
                    go(i + 1, a, b, total + channel, text)
                else:
                    s = int(slot[ord(c)])
                    go(i + 1, b, s, total + channel + float(cost[a, b, s]), text + c)
                    if s == b and text:
                        go(i + 1, a, b, total + channel + toxicity.DOUBLED, text)

        go(0, 0, 0, 0.0, "")
        return best[1]

    for span in ("1d10t", "m0r0n", "tr4sh", "w.a.t.e.r", "h0u5e", "b00k"):
        assert toxicity.viterbi(span, cost) == brute(span)
    r = toxicity.Restorer(cost)
    assert r.restore("An 1D10T, i d i o t (m0r0n)!!! word$$$ 12:30") == "an idiot, idiot (moron)!!! word$$$ 12:30"


def test_obfuscations_next_to_punctuation_and_of_mixed_signs():
    r = toxicity.Restorer(model_of("idiot moron trash scum loser pathetic the water house you number " * 50))
    want = {
        "you i d i o t.": "you idiot.", "m o r o n,": "moron,", "(s c u m)": "(scum)", "p @ t h e t i c": "pathetic", "l053r": "loser", "idi07": "idiot",
        "i-d-1-o-t": "idiot", "m.0.r.0.n": "moron", "i/d/i/o/t": "idiot", "i^d^i^o^t": "idiot", "iddiot": "idiot",
        "house12 scoop's 1 2 3 4 1.2.3.4 * * * *": "house12 scoop's 1 2 3 4 1.2.3.4 * * * *",
    }
    assert {k: r.restore(k) for k in want} == want


def test_the_lattice_decides_and_decodes_whole_spans():
    r = toxicity.Restorer(model_of("idiot moron trash scum ass boo loser the water house you number " * 50))
    for said, want in {"a55": "ass", "b00": "boo", "idi0t": "idiot", "idioot": "idiot", "id-i-ot": "idiot"}.items():
        assert r.restore(said) == want
    for same in ("9233a8ec41f07b6d2c55e019", "x4", "12-30-45", "well-known", "http"):
        assert r.restore(same) == same
    words = ["idiot", "moron", "trash", "scum", "loser"] * 30
    leet = str.maketrans("aeiost", "431057")
    long = ".".join(".".join(w.translate(leet)) for w in words)
    assert len(long) > 1000 and r.restore(long) == "".join(words)  # no place is read without what stands before it
    began = time.process_time()
    assert len(r.restore("4b" * 20_000)) >= 20_000 and time.process_time() - began < 60


def test_toxicity(spark, corpus):
    rng = random.Random(6)
    bad = ["idiot", "moron", "1d10t", "m0r0n", "i d i o t"]
    toxic = [(2000 + i, prose("en", 20, rng) + " " + " ".join(rng.choice(bad[: 2 if i < 40 else 5]) for _ in range(3)) + " " + prose("en", 20, rng), "en", "s0") for i in range(90)]
    both = corpus.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(toxic, SCHEMA))
    labels = both.where("doc_id is not null").select("doc_id", (F.col("doc_id") >= 2000).cast("int").alias("toxic")).distinct()
    out = toxicity.classify(both, labels)
    counts_ids(out, both)
    rows = [r for r in out.collect() if r["doc_id"] is not None]
    held = [(r["doc_id"] >= 2000) == bool(r["predicted"]) for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] in (900, 901, 902))
    assert toxicity.classify(both, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.classify(both.limit(0), labels).count() == 0
    assert toxicity.restore(both).where("restored is null").count() == 0


def word_shingles(text: str | None) -> frozenset:
    """The definition, on words themselves."""
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_audits_linked_texts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        w = prose("en", 80, rng).split()
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join([*w[:40], "other", *w[41:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = jaccard.audited_texts(df)
    assert len(texts) == 128
    sig = jaccard.signed(df, jaccard.Audit(texts, jaccard.TREES, jaccard.DEPTH), 0.8, jaccard.TREES, jaccard.DEPTH)
    assert jaccard.audited_recall(sig, jaccard.DEPTH)[6] >= 0.98
    few = jaccard.signed(df, jaccard.Audit(texts[:20], jaccard.TREES, jaccard.DEPTH), 0.8, jaccard.TREES, jaccard.DEPTH)
    assert jaccard.audited_recall(few, jaccard.DEPTH) == {}
    long = df.withColumn("text", F.repeat("text", 1000))
    assert jaccard.audited_texts(long) == [] and jaccard.audited_texts(df.limit(0)) == []


def test_jaccard_against_all_pairs(spark):
    rng = random.Random(7)
    texts = {i: prose("en", rng.randint(5, 120), rng).split() for i in range(30)}
    rows = []
    for i, w in texts.items():
        rows.append((i, " ".join(w)))
        for k in range(rng.randint(0, 4)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "changed"
            rows.append((100 + i * 10 + k, " ".join(v)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "One"), (904, "one two"), (None, "one"), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("h", F.lit(2))
    known = [(i, word_shingles(t)) for i, t in rows]
    links, up = defaultdict(int), list(range(len(known)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            s, t = known[a][1], known[b][1]
            if s and t and len(s & t) >= 0.8 * len(s | t):
                links[a] += 1
                links[b] += 1
                up[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for k, (i, _) in enumerate(known):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    got = sorted(map(str, ((r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard.join(df).collect())))
    assert got == sorted(str((known[k][0], links[k], smallest.get(find(k)))) for k in range(len(known)))
    kept = jaccard.keep(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(smallest.values()))
    assert jaccard.join(df.limit(0)).count() == 0 and jaccard.keep(df.limit(0)).count() == 0


def test_jaccard_keeps_texts_of_repeated_and_missing_ids(spark):
    rng = random.Random(17)
    a, b, c = (prose("en", 60, rng) for _ in range(3))
    df = spark.createDataFrame([(1, a), (1, b), (None, c), (None, c), (2, a), (None, None), (3, "w " * 30_000)], "doc_id long, text string")
    assert sorted(map(str, ((r["doc_id"], (r["text"] or "")[:60]) for r in jaccard.keep(df).collect()))) == sorted(map(str, [(1, a[:60]), (1, b[:60]), (None, c[:60]), (None, ""), (3, ("w " * 30)[:60])]))


def test_jaccard_hot_group_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(8)
    base = prose("en", 80, rng).split()
    rows = [(i, " ".join([*base[:40], f"w{i}", *base[41:]])) for i in range(30)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["n_links"], r["class_id"]) for r in got} == {(29, 0)}


def test_jaccard_of_a_chain_of_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(18)
    words = prose("en", 400, rng).split()
    rows = [(i, " ".join(words[3 * i : 3 * i + 90])) for i in range(90)]  # neighbours share much, others less and less
    sets = [frozenset(jaccard.shingles(t).tolist()) for _, t in rows]
    want = [sum(a is not b and len(a & b) >= 0.8 * len(a | b) for b in sets) for a in sets]
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n, 0) for i, n in enumerate(want)} and sum(want) > 100


def test_forest_level_shortens_until_both_targets_are_met():
    d = jaccard.forest_level(0.8, 24, 10, 0.999)
    assert jaccard.meets(0.8, d, 24) >= 0.999 > jaccard.meets(0.8, d + 1, 24)
    assert jaccard.forest_level(0.8, 24, 10, 0.999, {d: 0.5, d - 1: 0.99}) == d - 1 == jaccard.forest_level(0.8, 24, 10, 0.999, {}) and jaccard.forest_level(0.99, 24, 10, 0.999) == 10


def test_audit_finds_all_partners_and_their_prefixes():
    rng = random.Random(19)
    base = prose("en", 100, rng).split()
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 100, 9)] + [prose("de", 80, rng) for _ in range(9)]
    audit = jaccard.Audit(texts[:5] + texts[-2:], jaccard.TREES, jaccard.DEPTH)
    for t in texts:
        s = jaccard.shingles(t)
        label = jaccard.signature(s, jaccard.TREES, jaccard.DEPTH)
        got = {m // 64: m % 64 for m in audit.met(jaccard.node_of(s), s, label, 0.8)}
        for k, u in enumerate(texts[:5] + texts[-2:]):
            v = jaccard.shingles(u)
            meet = len(np.intersect1d(s, v))
            assert (k in got) == (t != u and meet >= 0.8 * (len(s) + len(v) - meet))
            if k in got:
                other = jaccard.signature(v, jaccard.TREES, jaccard.DEPTH)
                assert got[k] == max(next((d for d in range(jaccard.DEPTH) if x[d] != y[d]), jaccard.DEPTH) for x, y in zip(label, other, strict=True))


def poured(sizes, weights, total, most=2.0):
    """Brute force: share by weight, stop those above their cap, share again."""
    out, stopped = [0.0] * len(sizes), set()
    while True:
        rest, w = total - sum(most * sizes[i] for i in stopped), sum(weights[i] for i in range(len(sizes)) if i not in stopped)
        more = {i for i in range(len(sizes)) if i not in stopped and rest * weights[i] / w > most * sizes[i]}
        if not more:
            return [most * sizes[i] if i in stopped else rest * weights[i] / w for i in range(len(sizes))]
        stopped |= more


def test_targets_fill_like_water(spark):
    rng = random.Random(12)
    for sizes in ([100, 100, 100], [0, 10], [100, 10], [rng.randint(0, 10 ** rng.randint(0, 5)) for _ in range(300)]):
        names = sorted((f"{rng.choice('aé😀Z')}{i}" for i in range(len(sizes))), key=lambda x: x.encode())
        rows = list(zip(names, sizes, strict=True))
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targeted(df).collect()}
        want = poured(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
        assert [got[n] for n in names] == pytest.approx(want)


def test_split_tree_is_exact():
    counts = np.array([7, 0, 100, 33])
    q = mixing.split_tree(counts, 6)
    assert (q.sum(axis=1) == counts).all() and (q >= 0).all() and q.sum(axis=0).max() - q.sum(axis=0).min() <= 1
    assert (q == mixing.split_tree(counts, 6)).all()
    sizes = np.array([40, 0, 90, 10])
    q = mixing.split_tree(counts, 4, 3, sizes)
    assert (q.sum(axis=1) == counts).all() and (q.sum(axis=0) == sizes).all() and (q >= 0).all()
    assert mixing.split_tree(np.zeros(0, int), 4).shape == (0, 4)


def test_split_tree_draws_like_a_hypergeometric():
    left = [mixing.split_tree(np.array([30, 10]), 2, seed)[0, 0] for seed in range(400)]
    assert abs(np.mean(left) - 15) < 0.3 and abs(np.var(left) - 20 * 0.75 * 0.25 * 20 / 39) < 0.5


def test_mixing(spark, corpus, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BLOCKS", 8)
    monkeypatch.setattr(mixing, "PARTS", 2)
    one, two = (sorted(map(str, mixing.mix(corpus.repartition(n)).collect())) for n in (3, 7))
    assert one == two
    counts_ids(mixing.mix(corpus), corpus)
    rows = mixing.mix(corpus).collect()
    assert all(r["taken"] <= 2 * r["size"] and (r["taken"] > 0) <= bool(r["shards"]) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = poured(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
    for s, size, target in zip(names, sizes, want, strict=True):
        part = by[s]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(target) for r in part)
        assert abs(sum(r["taken"] for r in part) - target) <= 1
    assert mixing.mix(corpus.limit(0)).count() == 0 and mixing.draw(corpus.limit(0)).count() == 0
    drawn = mixing.draw(corpus)
    assert drawn.columns == corpus.columns
    times = {r["doc_id"]: r["n"] for r in drawn.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in rows:
        if r["doc_id"] not in (None, 0):  # 0 is there three times
            assert times.get(r["doc_id"], 0) == (round(r["taken"] / r["size"]) if r["size"] and 2 * (r["taken"] % r["size"]) != r["size"] else times.get(r["doc_id"], 0))
    mixing.write_shards(mixing.mix(corpus, shards=4), str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == sum(len(r["shards"]) for r in mixing.mix(corpus, shards=4).collect() if r["taken"])


def test_what_is_taken_follows_from_the_tree(spark, corpus, monkeypatch):
    taken = lambda: {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(corpus).collect()}
    tree = taken()
    to_first = lambda counts, shards, seed=0, sizes=None: np.column_stack([counts, np.zeros((len(counts), shards - 1), np.int64)])
    monkeypatch.setattr(mixing, "split_tree", to_first)
    assert taken() != tree


def test_many_sources_are_split_in_bundles(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUNDLES", 3)
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 40}") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(df, shards=8).collect()
    by, per_shard = defaultdict(list), defaultdict(int)
    for r in rows:
        by[r["source"]].append(r)
        for s in r["shards"] or []:
            per_shard[s] += 1
    assert all(abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 1 for part in by.values()) and len(by) == 40
    assert len(per_shard) == 8 and max(per_shard.values()) <= 1.6 * min(per_shard.values())


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(vocabulary_path()), random.Random(9)
    w = lambda n: "".join(rng.choice("theranionglyxz") for _ in range(n))
    rows = [(1, None), (2, ""), (3, "A " + w(3000) + " it's <|endoftext|> " + w(300)), (4, w(5000)), (4, w(70)), (5, w(700) + "!" * 900 + w(10)), (None, w(600)), (7, w(600)), (7, w(600))]
    rows += [rows[3]] + [(10 + i, "".join(rng.choice("abc É’sİΣς\t\n\x1c\x85漢²½😀!?.<|>'") for _ in range(40))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("row", F.lit(2))
    got = sorted(map(str, map(tuple, bpe.encode(df, vocabulary_path(), leaf_chars=128, spread_chars=512, digest=True).collect())))
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    assert got == sorted(want)
    b = bpe.loaded(open(vocabulary_path()).read(), "test")
    whole = bpe.encode(df.where("doc_id = 2 or doc_id = 12"), vocabulary_path()).collect()
    assert all(b.decode(r["ids"]) == r["decoded"] and len(array("I", r["ids"])) == r["n_tokens"] for r in whole)
    assert bpe.encode(df.limit(0), vocabulary_path()).count() == 0


def test_bpe_trees_of_whole_texts_in_a_given_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert sum(len(x) > bpe.LEAF_CHARS for x in text.values()) > 100 and sum(len(x) > 8192 for x in text.values()) > 10
    got = {r["doc_id"]: (array("I", r["ids"]).tolist(), r["decoded"]) for r in bpe.encode(docs, vocabulary_path(), spread_chars=8192).collect()}
    for i, x in text.items():
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[i] == (ids, t.decode(ids, skip_special_tokens=False))


def test_bpe_seams_are_within_pre_tokens():
    b = bpe.loaded(open(vocabulary_path()).read(), "test")
    words = b.all_words("Thenation <|endoftext|> " + "international " * 40 + "x" * 300 + " é漢字." * 20)
    for most in (1, 3, 7, 50):
        cut = b.stretches(words, False, most)
        assert sum(o for _, o in cut) > len(cut) / 4 and "".join(w for ws, _ in cut for w in ws) == "".join(words)
        assert b"".join(e[0] for e in b.entries(words, False, most)) == b"".join(e[0] for e in b.leaf(words, False))


def test_bpe_join_at_every_place():
    b, rng = bpe.loaded(open(vocabulary_path()).read(), "test"), random.Random(10)
    for _ in range(200):
        s = "".join(rng.choice("theranionglyxz") for _ in range(rng.randint(2, 60)))
        k = rng.randint(1, len(s) - 1)
        assert b.join(b.merge(b.symbols(s[:k], False)), b.merge(b.symbols(s[k:]))) == b.merge(b.symbols(s))
