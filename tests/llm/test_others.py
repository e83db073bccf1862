"""Operators on vectors, conversations and pages, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from spokeline.llm import ann, chat, common, html, jaccard, language, mixing, neardup, quality


def vectors(spark, seed=1, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[300:340] = x[300] + rng.standard_normal((40, d)) * 0.05  # a dense group
    x[340:345] = x[0]  # copies
    label = np.arange(n) % 3
    label[300:345] = 1
    label[0] = 1
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    odd = [(1000, None, 1), (1001, [0.0] * d, 1), (1002, [float("nan")] * d, 1), (1003, [None] + [1.0] * (d - 1), 1), (1004, [1.0], 1), (1005, x[0].tolist(), None), (None, x[0].tolist(), 1), (1006, [float("inf")] * d, 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    return df.withColumn("rep", F.lit(1)).withColumn("x", F.lit(2)).withColumn("n", F.lit(3)), x, label


def brute_links(x, label, threshold=0.93):
    y = x / np.linalg.norm(x, axis=1)[:, None]
    g = (y @ y.T >= threshold - 1e-12) & (label[:, None] == label[None])
    np.fill_diagonal(g, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min(comp[i], comp[g[i]].min()) if g[i].any() else comp[i] for i in range(len(x))])
        if (new == comp).all():
            return g.sum(1), comp
        comp = new


def test_vector_links(spark):
    df, x, label = vectors(spark)
    n, comp = brute_links(x, label)
    rows = neardup.links(df).collect()
    out = {r["vec_id"]: r for r in rows}
    assert len(rows) == df.count() == 408
    n[[0, *range(340, 345)]] += 1  # the row without an id is a copy of these
    assert [out[i]["n_links"] for i in range(400)] == n.tolist() and [out[i]["component_id"] for i in range(400)] == comp.tolist()
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006))
    assert (out[None]["n_links"], out[None]["component_id"], out[None]["kept"]) == (6, 0, False)
    assert neardup.links(df.limit(0)).count() == 0


def test_vectors_of_other_lengths_and_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0, 0.0], 1), (4, [2.0, 0.01, 0.0], 1), (5, [1.0, 0.0], 2), (None, [0.0, 1.0], 1), (None, [-0.0, 2.0], 1), (7, [1.0, 0.0], 1), (7, [0.0, 1.0], 2), (8, [0.0, -1.0, 0.0, 5.0], 1)]
    got = sorted(map(str, (tuple(r)[:3] for r in neardup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect())))
    want = [(1, 2, 1), (2, 2, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (None, 1, None), (None, 1, None), (7, 2, 1), (7, 0, 7), (8, 0, 8)]
    assert got == sorted(map(str, want))


def test_vector_links_in_small_shards_and_cells(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 40), ("BLOCK", 32), ("CELL", 60), ("QUERIES", 16)):
        monkeypatch.setattr(neardup, name, value)
    df, x, label = vectors(spark)
    n, _ = brute_links(x, label)
    got = {r["vec_id"]: r["n_links"] for r in neardup.links(df.where("vec_id is not null")).collect()}
    assert sum(min(got[i], n[i]) for i in range(400)) >= 0.9 * n.sum() and all(got[i] <= n[i] for i in range(400))


def test_vector_links_of_a_label_above_a_cell(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x = unit(rng.standard_normal((10_000, 64)))
    aside = rng.standard_normal((1_500, 64))
    aside = unit(aside - (aside * x[:1_500]).sum(axis=1)[:, None] * x[:1_500])
    x = np.vstack([x, 0.94 * x[:1_500] + np.sqrt(1 - 0.94**2) * aside])  # partners at a cosine of 0.94
    n = ((x @ x.T) >= neardup.THRESHOLD).sum(axis=1) - 1
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "label": 1}))
    got = {r["vec_id"]: r for r in neardup.links(df).collect()}
    assert all(got[i]["n_links"] <= n[i] for i in range(len(x)))
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.98 * n.sum() and n.sum() >= 3_000
    assert sum(got[i + 10_000]["component_id"] == i for i in range(1_500)) >= 0.98 * 1_500


def test_audit_weighs_vectors_alike_and_ends_exact(spark, monkeypatch):
    assert neardup.recall({1: 5000, 2: 0}, {1: 5000, 2: 2, 3: 0}) == 0.5 and neardup.recall({}, {1: 0}) == 1
    monkeypatch.setattr(neardup, "MAX_DEGREE", neardup.DEGREE)
    rng = np.random.default_rng(8)
    a, b = np.eye(32)[0], 0.95 * np.eye(32)[0] + np.sqrt(1 - 0.95**2) * np.eye(32)[1]
    x = np.vstack([np.tile(v, (150, 1)) + rng.standard_normal((150, 32)) * 0.003 for v in (a, b)])  # two tight clusters, no edges between them
    n, comp = brute_links(x, np.zeros(300))
    assert n.min() == 299
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(300), "embedding": x.tolist(), "label": 1}))
    got = {r["vec_id"]: r for r in neardup.links(df).collect()}
    assert [got[i]["n_links"] for i in range(300)] == n.tolist() and [got[i]["component_id"] for i in range(300)] == comp.tolist()


def neighbours(rows, k=10):
    """Brute force: rows of (vec_id, vector), queries are ids divisible by 100."""
    out = {}
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        v = min(x for i, x in rows if i == q)
        best = {}
        for i, x in rows:
            if i != q and len(x) == len(v):
                d = float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum()))
                best[i] = min(best.get(i, d), d)
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def check_neighbours(spark, rows, least):
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame([(i, x) for i, x in rows], "vec_id long, embedding array<double>").withColumn("d", F.lit("x")).withColumn("code", F.lit(1)), F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    want, hit, total = neighbours(rows), 0, 0
    assert set(got) <= set(want)
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        true = dict((i, d) for d, i in neighbours_of(rows, q))
        assert all(abs(true[i] - d) < 1e-9 for _, d, i in mine)
        hit, total = hit + len({i for _, _, i in mine} & {i for _, i in best}), total + len(best)
    assert hit >= least * total
    return got


def neighbours_of(rows, q):
    return neighbours([r for r in rows if r[0] == q or r[0] % 100], 10**6)[q] + [x for x in neighbours(rows, 10**6)[q] if x[1] % 100 == 0]


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    for d in (16, 64, 80):
        x = rng.standard_normal((500, d))
        x[340:352] = x[0]  # ties
        check_neighbours(spark, [(i, v.tolist()) for i, v in enumerate(x)], 0.9)
    df, _, _ = vectors(spark, seed=3)
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id < 4"), F.col("vec_id") % 100 == 0).count() == 3  # all there are
    assert {r["query_id"] for r in ann.search(df, F.col("vec_id") % 100 == 0).collect()} == {0, 100, 200, 300}  # 1000 is null


def test_neighbours_of_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1, 60)] + [(100, [1.0] * 8), (100, [0.5] * 8), (7, [0.5] * 8), (200, [1.0, 2.0]), (201, [1.0, 2.5]), (300, [4.0] * 3)]
    got = check_neighbours(spark, rows, 0.7)  # eleven neighbours in all
    assert got[100][0][2] == 7 or (1, 0.0, 7) in got[100]
    assert got[200] == [(1, 0.5, 201)] and not got[300]


def test_neighbours_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 64)) * 3
    x = centres[rng.integers(12, size=1500)] + rng.standard_normal((1500, 64)) * 0.3
    x[500:800] = x[500]  # a hot bucket
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check_neighbours(spark, rows, 0.9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    looked = ann.found_by(df, F.col("vec_id") % 100 == 0).groupBy("query_id").agg(F.sum("looked").alias("n")).agg(F.avg("n")).first()[0]
    assert looked < 0.6 * len(rows)  # in clusters, most lists are never read


def test_postings_find_every_code_within_a_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    codes = np.concatenate([codes, codes[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))])
    indexes = [ann.Postings(codes, j) for j in range(4)]
    for q in range(20):
        for radius in (0, 1, 3, 7, 20, 26, 64):
            want = np.flatnonzero(np.bitwise_count(codes ^ codes[q]) <= radius)
            got = np.concatenate([i.within(codes[q], radius)[0] for i in indexes])
            assert (np.sort(got) == want).all()  # each by one index only


def test_chat_round_trip_and_branches(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant ok", "\\<|", "<\\|x|>", "a\\", "", "|><|"]
    rows = [(c, t, ["user", "assistant", "system"][t % 3], x) for c in (1, 2) for t, x in enumerate(nasty)] + [(3, 0, None, None), (3, 0, "assistant", "same turn"), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("score", F.lit("x"))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_paths(chat.turns(df))).collect()}
    for c in (1, 2, 3, None):
        mine = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (out[c]["n_turns"], out[c]["turns_sha256"]) == (len(mine), sha("".join(f"{r}\n{x}\n" for _, r, x in mine)))
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.format_paths(chat.turns(df.limit(0))).count() == 0
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", None), (1, 5, 99, "user", "orphan", 0.5)]
    t = spark.createDataFrame(tree, "conv_id long, node long, parent long, role string, text string, score double")
    best = chat.format_paths(t, 1).collect()
    assert len(best) == 1 and best[0]["formatted"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    f, s = best[0]["formatted"], best[0]["loss_spans"]
    assert [f[x["start"] : x["start"] + x["length"]] for x in s] == ["good"]
    # two and three messages in a circle, with a tail each; the id that once stood for none
    ring = [(5, 1, 2, "user", "a", 0.0), (5, 2, 1, "user", "b", 0.0), (5, 3, 2, "user", "c", 0.0), (None, 1, 3, "user", "x", 0.0), (None, 2, 1, "user", "y", 0.0), (None, 3, 2, "user", "z", 0.0), (None, 4, 1, "user", "t", 0.0), (-(1 << 62), 1, None, "user", "alone", 0.0)]
    got = chat.paths(spark.createDataFrame(ring, "conv_id long, node long, parent long, role string, text string, score double")).collect()
    assert sorted((r["c"], r["leaf"], r["node"], r["height"]) for r in got) == sorted([("5", 3, 3, 0), ("5", 3, 2, 1), ("5", 3, 1, 2), ("none", 4, 4, 0), ("none", 4, 1, 1), ("none", 3, 3, 0), ("none", 3, 2, 1), ("none", 3, 1, 2), (str(-(1 << 62)), 1, 1, 0)])
    long = spark.createDataFrame([(1, 1, None, "assistant", "é<|x\\" * 300_000, 0.0)], "conv_id long, node long, parent long, role string, text string, score double")
    assert chat.read_back(chat.format_paths(long)).first()["loss_chars"] == 5 * 300_000
    assert [round(r["branch_score"], 1) for r in sorted(chat.format_paths(t, None).collect(), key=lambda r: r["branch"])] == [2.0, 0.5, -1.0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>A</a></ul></nav>
<!-- ad --><div class="ad">Buy, now, please.</div><article><h1>Head&nbsp;line</h1><p><b>First &amp;  para,<br>graph.<p>Second &lt;one&gt; with a <a href=x>link</a>, &#233;t&eacute;.</p></article>
<div class="comments"><p>Great, post, yes, it, is, so, very, long.</p></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "Head line\nFirst & para, graph.\nSecond <one> with a link, été."
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>alone"), (1, "u", PAGE), (5, "x", "<div><p>unclosed <div"), (6, "y", "plain text, no tags")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect()]
    assert got.count((1, want, len(want))) == 2 and (2, "", 0) in got and (3, "", 0) in got and (None, "alone", 5) in got and (6, "plain text, no tags", 19) in got
    assert html.extract(df.limit(0)).count() == 0
    assert html.main_text("<div>" * 3000 + "<p>deep, text" + "</div>" * 3000) == "deep, text"


def naive_page(rng, depth=0):
    """A random tree as (tag, class, children); a leaf is (tag, text before a link, text of the link)."""
    if depth and rng.random() < 0.4 or depth > 6:
        words = lambda n: " ".join(rng.choice(["word", "more,", "then", "end."]) for _ in range(n))
        return (rng.choice(["p", "h2", "blockquote"]), words(rng.randint(1, 30)), words(rng.randint(0, 8)))
    return (rng.choice(["div", "section", "ul", "article"]), rng.choice(["", "", "content", "side", "x"]), [naive_page(rng, depth + 1) for _ in range(rng.randint(1, 5))])


def markup(node):
    if isinstance(node[2], list):
        return f"<{node[0]} class='{node[1]}'>" + "".join(map(markup, node[2])) + f"</{node[0]}>"
    return f"<{node[0]}>{node[1]} <a href=x>{node[2]}</a></{node[0]}>"


def naive_text(root):
    """The rule of the operator, by definition: every block's points to each of its ancestors, one by one."""
    score, order, blocks_of = {}, [], {}
    text_of = lambda b: f"{b[1]} {b[2]}".strip()

    def visit(node, path, up):
        if not isinstance(node[2], list):
            text = text_of(node)
            p = (1 + text.count(",") + min(3, len(text) / 100)) * (1 - min(len(node[2].strip()), len(text)) / len(text))
            for k, a in enumerate(reversed(path)):
                score[id(a)] = score.get(id(a), 0) + p * 0.5**k
                blocks_of.setdefault(id(a), []).append(text)
        elif node[1] != "side":
            order.append((node, up))
            for c in node[2]:
                visit(c, [*path, node], node)

    visit(root, [], None)
    bonus = lambda n: 25 * (n[0] == "article") + 10 * (n[1] == "content")
    best = max(order, key=lambda x: score.get(id(x[0]), 0) + (bonus(x[0]) if score.get(id(x[0]), 0) > 0 else 0), default=None)
    if best is None or not score.get(id(best[0])):
        return []
    node, up = best
    if up is None or node[0] == "article":
        return blocks_of[id(node)]
    out = []
    for c in up[2]:
        if not isinstance(c[2], list):
            text = text_of(c)
            if c[0] == "h2" or (min(len(c[2].strip()), len(text)) < 0.25 * len(text) and (len(text) > 80 or text[-1:] in ".!?…")):
                out.append(text)
        elif c[1] != "side" and (c is node or score.get(id(c), 0) >= html.SIBLING_SHARE * score[id(node)]):
            out += blocks_of.get(id(c), [])
    return out


def test_html_scores_against_their_definition():
    rng, kept = random.Random(21), 0
    for _ in range(400):
        page = naive_page(rng)
        got = html.main_text(markup(page))
        assert got == "\n".join(naive_text(page))
        kept += bool(got)
    assert kept > 200


def test_html_takes_time_in_proportion():
    began = time.process_time()
    assert html.main_text("<p>before<a" + '""' * 100_000).startswith("before<a")
    assert html.main_text("<a '" * 60_000 + "><p>x") in ("x", "")
    assert html.main_text("<svg>" * 60_000 + "<p>a, b.") == "a, b."
    assert html.main_text("<h1>" * 60_000 + "<p>x</p>" * 30_000).count("x") == 30_000
    assert len(html.main_text("".join("<div><p>a, b, c" for _ in range(30_000)))) > 8
    assert html.main_text("<!--" * 60_000) == "" and html.main_text("<![CDATA[" * 30_000) != ""
    ten_mb = "<div><p>word, word <a href='x'>link</a></p></div>" * 210_000
    assert len(ten_mb) > 10_000_000 and html.main_text(ten_mb).count("word, word link") == 210_000
    assert time.process_time() - began < 60


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, 500 + k) for k in range(1, 60)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_pipeline_against_its_parts(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(120).cache()
    now, labels = docs, spark.read.parquet(f"{d}/labels.parquet")
    q = {r["doc_id"] for r in quality.classify(now, labels).where("predicted = 1").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = stage(spark, now, d)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == docs.columns
        now = common.written(now)
        ids = sorted(r["doc_id"] for r in now.select("doc_id").collect())
        if k == 0:
            assert ids == sorted(q)
        elif k == 1:
            assert ids == sorted(r["doc_id"] for r in language.keep(before).collect()) and set(ids) <= {r["doc_id"] for r in language.identify(before).where("lang_pred <> 'und'").collect()}
        elif k == 2:
            assert ids == sorted(r["doc_id"] for r in jaccard.join(before).where("kept").collect())
        elif k == 3:
            want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(before).collect() if r["size"]}
            got = {r["doc_id"]: r["n"] for r in now.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
            assert got == {i: n for i, n in want.items() if n}
    assert set(now.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and now.count() > 0


def test_stages_take_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0).withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_stages_take_odd_rows_and_clashing_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    long = " ".join(r["text"] for r in docs.limit(20).collect())
    odd = spark.createDataFrame([(None, None, None, None, None), (None, long[:900], "en", "src1", 900), (7, None, "en", "src1", 0), (8, "", None, None, 0), (9, long, "en", None, len(long)), (9, long, "en", None, len(long)), (10, long[5:], "xx", "", 1)], docs.schema)
    now = docs.unionByName(odd).unionByName(docs.limit(5))
    for clash in ("row", "draw", "block", "copies", "whole", "extra", "h", "node", "shards", "label", "n_tokens", "size", "words"):
        now = now.withColumn(clash, F.lit(clash))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, common.written(stage(spark, now, d))
        rows = now.collect()
        assert rows, name
        if k < 4:
            assert now.columns == before.columns
            texts = {r["text"] for r in before.collect()}
            assert all(r["text"] in texts and r["draw"] == "draw" for r in rows)  # whole texts, and columns as they were
        if name == "near_duplicates":
            assert len(rows) == len({(r["doc_id"], r["text"]) for r in rows})


def test_workers_give_memory_back_at_the_end_of_a_task():
    from spokeline.llm.common import released

    mb = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
    words = [[f"{i} {k}" for k in range(10)] for i in range(200_000)]
    keep, most = [w[0] for w in words[::5000]], mb()
    del words
    released()
    assert most - mb() > 50 and len(keep) == 40


def test_whole_texts_go_to_workers_a_few_megabytes_at_a_time(spark):
    from spokeline.llm.common import BATCH_BYTES

    def sizes(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches], pa.int64())], ["bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    docs = spark.range(1500, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 2000) as text", "'en' as lang", "'web' as source", "0 as n_chars")
    try:
        for stage in (corpus_pipeline.known_language, corpus_pipeline.token_ids):
            spark.conf.set(key, "67108864b")
            stage(spark, docs.limit(3), "")
            got = [r[0] for r in docs.mapInArrow(sizes, "bytes long").collect()]
            assert sum(got) > 3 * BATCH_BYTES and max(got) < 1.5 * BATCH_BYTES
        spark.conf.set(key, "1024b")
        corpus_pipeline.token_ids(spark, docs.limit(3), "")
        assert spark.conf.get(key) == "1024b"
    finally:
        spark.conf.set(key, was)
    # what lies before each range is not passed through Python workers of another kind
    few = spark.range(100).selectExpr("id", "id % 7 as n")
    out = mixing.ranged(few, [F.col("id")], {"ahead": F.col("n")})
    assert "ExistingRDD[" not in out._jdf.queryExecution().toString()
    assert {r["id"]: (r["rank"], r["ahead"]) for r in out.collect()} == {i: (i, sum(k % 7 for k in range(i))) for i in range(100)}
