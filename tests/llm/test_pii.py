"""Personal data: base patterns, the field's sums against listing all segmentations, what it adds and what it leaves alone."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spokeline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_digit(digits):
    twice = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(sum(map(int, str(v))) for v in twice) % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and check_digit(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(2)
    found = 0
    for k in range(40_000):
        text = "".join(rng.choice(rng.choice(["ab.@", "1..2", "+1 (-)", "0123456789 -", "a@b.c_%", "é٣\n", "0025"])) for _ in range(rng.randint(0, 30)))
        if k % 4 == 0:
            text += pii.made_span(rng, rng.choice(pii.KINDS)) + rng.choice(["", ".", "x", "9"])
        want = plain(text)
        found += len(want)
        assert pii.base_spans(text) == want, text
    assert found > 9_000


def test_sums_over_all_segmentations():
    """Best segmentation and probabilities against listing every segmentation of small clusters, under random weights."""
    rng = random.Random(4)
    tried = 0
    for _ in range(300):
        text = rng.choice(["{0} {1} {2}", "{0}-{1} {2}-{1}", "a at b dot c.d", "x.y at b dot {0}.c", "00{0} {2}.{1}", "({0}) {1} {2}", "{0}.{0}.{0}.{0}.{0}"]).format(rng.randint(1, 999), rng.randint(1, 9999), rng.randint(1000, 99999))
        for group in pii.clusters(pii.segments(text)):
            lattice = pii.Lattice(text, group)
            names = {f for s in group for f in s.features} | {f for fs in lattice.plain for f in fs} | {f"from {a} to {b}" for a in ("plain", "entity") for b in ("plain", *pii.KINDS)}
            field = pii.Field({n: rng.gauss(0, 1) for n in sorted(names)})
            n = len(lattice.ends)
            arcs = [(t, t + 1, None, field.score(f)) for t, f in enumerate(lattice.plain)] + [(s, t, k, field.score(group[k].features)) for t in range(n) for s, k in lattice.ends[t]]

            def all_of(at, before, n=n, arcs=arcs, field=field, group=group):
                if at == n - 1:
                    yield field.weights[f"from {before} to plain"], []
                for s, t, k, own in arcs:
                    if s == at:
                        kind = "plain" if k is None else group[k].kind
                        for rest, chosen in all_of(t, "plain" if k is None else "entity"):
                            yield rest + own + field.weights[f"from {before} to {kind}"], ([] if k is None else [k]) + chosen

            every = list(all_of(0, "plain"))
            if len(every) > 5000:
                continue
            tried += 1
            whole = sum(math.exp(v) for v, _ in every)
            got = field.decode(lattice)
            best = max(every, key=lambda x: x[0])
            assert [s for s, _ in got] == [group[k] for k in best[1]]
            for s, p in got:
                k = next(k for k in best[1] if group[k] is s)
                assert math.isclose(p, sum(math.exp(v) for v, c in every if k in c) / whole, rel_tol=1e-9, abs_tol=1e-12)
    assert tried > 100


@pytest.fixture(scope="module")
def field():
    return pii.fit([])


def test_disguised_spans_are_found_and_decoys_are_not(field):
    found = {k: [0, 0] for k in pii.KINDS}
    wrong = decoys = 0
    for text, a, b, kind in pii.training_set([], seed=99):
        base = pii.base_spans(text)
        added = field.added(text, base)
        if kind:
            found[kind][0] += (kind, a, b) in base or (kind, a, b) in [s[:3] for s in added]
            found[kind][1] += 1
            wrong += sum(s[1:3] != (a, b) for s in added)
        else:
            decoys += 1
            wrong += len(added)
    assert all(hit >= 0.9 * n for hit, n in found.values()), found
    assert decoys > 900 and wrong <= 0.01 * decoys
    told = "write to john.smith at example dot org, or 192 dot 168 dot 1 dot 7, card 4532.0151.1283.0366, tel 0049 170 555 1234."
    assert [(k, told[a:b]) for k, a, b, _ in field.added(told, [])] == [("email", "john.smith at example dot org"), ("ip", "192 dot 168 dot 1 dot 7"), ("card", "4532.0151.1283.0366"), ("phone", "0049 170 555 1234")]
    clean = "On 2024-11-28 we met at noon. Pages 120-135, 12 15 18 20 33 40, ISBN 978-3-16-148410-0, card 4532.0151.1283.0367, look at example.com, 1,234,567.89 or 3.14159 of 2 000 000."
    assert field.added(clean, pii.base_spans(clean)) == []


def test_table(spark, field):
    rows = [(1, "mail a.b@c.de, ip 1.2.3.4 and 1.2.3.400, +1 (564) 555-4526"), (2, None), (3, ""), (None, "a@b.c"), (4, "4532015112830366 4532 0151 1283 0366 é a@b.c"), (4, "a@b.c"), (5, "reach jane at corp dot example dot org"), (6, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("h", F.lit(2)).withColumn("kind", F.lit(3))
    found = pii.find(df, field=field)
    got = sorted((tuple(r) for r in pii.report(found).collect()), key=str)
    want = []
    for i, text in rows:
        base = plain(text or "")
        say = lambda spans: ",".join(":".join(map(str, s)) for s in spans)
        extra = [("email", 6, len(text))] if i == 5 else []
        want.append((i, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(say(base).encode()).hexdigest(), say(base + extra), len(extra)))
    assert got == sorted(want, key=str)
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(df.where("doc_id in (1, 2, 5)"), field=field).collect()}
    assert hidden == {1: "mail [EMAIL], ip [IP] and 1.2.3.400, [PHONE]", 2: None, 5: "reach [EMAIL]"}
    assert pii.find(df.limit(0)).count() == 0
    fitted = pii.report(pii.find(df)).collect()  # fitted on the table itself
    assert sorted(r["base_sha256"] for r in fitted) == sorted(w[5] for w in want)


def test_long_texts_in_time(field):
    began = time.time()
    for text in ["1" * 500_000, "1 " * 200_000, "123 " * 30_000, "+1" * 200_000, "a@" * 100_000, "@" * 200_000, "1." * 100_000, "(at)" * 100_000, " at a." * 100_000, "a." * 200_000 + "@b.c", "a dot " * 100_000, "x[at]y.z " * 10_000]:
        pii.spans_of(text, field)
    assert time.time() - began < 60
