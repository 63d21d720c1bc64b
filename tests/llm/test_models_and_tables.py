"""Trained filters, chat logs, vectors and the pipeline."""
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from palimpsest.llm import chat, components, license_scan, near_dedup, topk, toxicity, url_filter
from palimpsest.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


# url filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    return host, m[2] if m else ""


def rule(host, path):
    fits = [(v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[1]), default=(None, None))


def test_urls_by_rule_and_by_model(spark):
    urls = ["http://A.net/x", "https://Example.NET/en/1", "x.example.net", "http://example.net/en", "http://notexample.com/de/1", "ftp://a.example.com/de/?q#f",
            "http://b.org/fr/1", "http://b.org/FR/1", "http://net", "http://net/", "http://a.net?x=1", None, "", "no scheme", "http://", "http://é.Org/fr/ü?x",
            "a://b://c/d", "http://h\nost.net/p\nq", "http://www.spam-farm.org/en/1", "http://www.spam-farm.org/en/1", "https://kitchen.example.com/en/" + "a" * 5000]
    frame = spark.createDataFrame([(i, u, "old", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, other int")
    got = url_filter.verdicts(frame)
    assert got.columns == ["page_id", "other", "host", "path", "rule", "verdict", "p_block"]
    weights = url_filter.fit(url_filter.labelled(spark))
    for r in got.collect():
        host, path = parts(urls[r.page_id])
        verdict, name = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name), urls[r.page_id]
        cells = set()
        for mark, text in (("h", f"^{host}$"), ("p", f"^{path}")):
            for n in url_filter.SIZES:
                for i in range(len(text) - n + 1):
                    seed = xxhash.xxh64_intdigest(mark.encode(), 42)
                    h = xxhash.xxh64_intdigest(text[i:i + n].encode(), seed)
                    cells.add((h - (1 << 64) if h >> 63 else h) % (1 << url_filter.BITS))
        p = 1 / (1 + np.exp(-(weights[0] + sum(weights[1][c] for c in cells))))
        assert abs(p - r.p_block) < 1e-9 and r.verdict == (verdict or ("block" if p >= 0.5 else "allow"))
    assert url_filter.verdicts(frame.limit(0)).count() == 0


def test_url_model_on_words_it_was_not_shown(spark):
    labels = url_filter.labelled(spark)
    shown = labels.where("not (url rlike 'cheap-pills|casino-bonus|museum|travel')")
    unseen = labels.where("url rlike 'cheap-pills|casino-bonus|museum|travel'").withColumnRenamed("label", "y")
    rows = url_filter.verdicts(unseen.selectExpr("url", "y"), shown, rules=()).collect()
    assert np.mean([(r.verdict == "block") == bool(r.y) for r in rows]) > 0.8


def test_url_paths_count_on_hosts_that_were_not_shown(spark):
    hosts = ["some-site.org", "portal.example.edu", "bakery-lane.com", "www.quiet-lake.info", "tools.qrst.io", "m.papers.example.org"]
    bad = ["/casino-bonus/cheap-pills", "/en/free-viagra/77", "/de/online-casino/12", "/shop/cheap_replica_watches.html", "/fr/xxx-videos", "/payday-loans/apply"]
    good = ["/about/contact", "/en/history-of-music/77", "/de/article/12", "/shop/garden_chairs.html", "/fr/news", "/docs/install/apply", "/", "", "/en/4711"]
    rows = [(f"https://{h}{p}", int(p in bad)) for h in hosts for p in bad + good]
    got = url_filter.verdicts(spark.createDataFrame(rows, "url string, y int"), rules=()).collect()
    for y in (0, 1):
        assert np.mean([(r.verdict == "block") == bool(r.y) for r in got if r.y == y]) > 0.95, [(r.host, r.path, r.p_block) for r in got if (r.verdict == "block") != bool(r.y)]


# license scan

def test_notices_are_found_and_prose_is_not(spark):
    prose = [" ".join(random.Random(i).choices("the of this is under version free and work to license copy river mountain".split(), k=20)) for i in range(60)]
    texts = [(i, p) for i, p in enumerate(prose)] + [
        (100, "intro text here\nLicensed under the Apache License, Version 2.0.\nmore"), (101, "Released under the MIT License."), (102, "All rights reserved."),
        (103, "text\n\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (104, None), (105, ""), (105, ""),
        (106, "license the under licensed version apache 2.0")]
    frame = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, notices string")
    out = license_scan.scan(frame)
    assert out.columns == ["doc_id", "n_paragraphs", "notices", "families"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[100].families == ["apache-2.0"] and got[100].notices[0].line == 2 and got[101].families == ["mit"] and got[102].families == ["proprietary"]
    assert got[103].families == ["cc-by-nc", "gpl"] and got[103].n_paragraphs == 3 and got[104].n_paragraphs == 0 and got[105].families == []
    assert sum(bool(got[i].families) for i in range(60)) == 0
    assert license_scan.scan(frame.limit(0)).count() == 0


def test_notices_inside_long_lines_are_found(spark):
    rng = random.Random(14)
    vocab = ["".join(rng.choices("klmnopqr", k=6)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    inside = lambda *notices: " ".join([prose(100), *[f"{n} {prose(100)}" for n in notices]])
    own = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts]
    texts = [(i, inside(t)) for i, (_, t) in enumerate(own)]
    texts += [(1000, prose(40) + " All rights reserved."), (1001, inside("Released under the MIT License.", "Licensed under CC BY-NC 4.0.")),
              (1002, inside("it was released under the old bridge to any person")), (1003, "Released under the MIT License."),
              (1004, "Released under the MIT License. All rights reserved."), (1005, "Licensed under the GNU Lesser General Public License, version 2.1.")]
    texts += [(2000 + i, prose(200)) for i in range(40)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, (family, text) in enumerate(own):
        assert got[i].families == [family], text
    assert got[1000].families == ["proprietary"] and got[1001].families == ["cc-by-nc", "mit"] and got[1002].families == [] and got[1003].families == ["mit"]
    assert got[1004].families == ["mit", "proprietary"] and got[1005].families == ["lgpl"]
    assert not any(got[2000 + i].families for i in range(40))


def test_other_and_negated_notices_are_no_family(spark):
    prose = lambda i, n: " ".join(random.Random(i).choices("stone water field quiet amber under version free the of is to".split(), k=n))
    good = {"GNU Affero General Public License": "agpl", "Distributed under the Eclipse Public License 2.0.": "epl", "Licensed under the ISC License.": "isc",
            "Copyright 2021 Jane. All rights reserved.": "proprietary", "See the GNU General Public License for more details.": "gpl",
            "It is not yours. All rights reserved.": "proprietary", prose(1, 700) + " Released under the MIT License. " + prose(2, 700): "mit"}
    bad = ["Not licensed under the MIT License.", "This file is not licensed under the MIT License in any form.", "The software isn't released under the Apache License 2.0.",
           prose(3, 30) + " Not released under the MIT License. " + prose(4, 30), *license_scan.OTHERS]
    texts = [(i, t) for i, t in enumerate([*good, *bad])] + [(1000 + i, prose(50 + i, 40)) for i in range(60)]
    got = {r.doc_id: r.families for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(good))] == [[f] for f in good.values()]
    assert {t: got[len(good) + i] for i, t in enumerate(bad) if got[len(good) + i]} == {}
    assert not any(got[1000 + i] for i in range(60))


def test_scan_equals_judging_every_line_and_window(spark):
    rng = random.Random(8)
    parts = [w.decode() for ts in license_scan.TEMPLATES.values() for t in ts for w in license_scan.words(t.encode())] + ["amber", "not", "field"] * 20
    own = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    line = lambda: " ".join(x for _ in range(rng.randrange(1, 5)) for x in (rng.choice(own), *rng.choices(parts, k=rng.randrange(8))))
    texts = [(i, "\n".join(line() for _ in range(rng.randrange(4)))) for i in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    model = license_scan.fit(frame)

    no = "|".join(w.decode() for w in license_scan.NEGATIONS)

    def holds(tokens, window, notice):
        """Enough of the notice's n-grams and one of its word pairs."""
        own = license_scan.grams(window)
        return any(g in notice for g in own[len(window):]) and sum(g in notice for g in own) >= 0.4 * len(notice) <= len(notice & set(license_scan.grams(tokens)))

    def families(text):
        out = set()
        for row in text.split("\n"):
            tokens = license_scan.words(row.encode())
            spans = {(i, i + len(t)) for ts in model.templates.values() for t in ts if 1 < len(t) < len(tokens) for i in range(len(tokens) - len(t) + 1)
                     if holds(tokens, tokens[i:i + len(t)], set(license_scan.grams(t)))}
            hits, taken = [((i, j), model.judge(tokens[i:j], 0.5, 0.4)) for i, j in spans], []
            for (i, j), h in sorted((x for x in hits if x[1]), key=lambda x: (-x[1][2], -x[1][1], x[0])):
                if not any(i < q and p < j for (p, q), _ in taken):
                    taken.append(((i, j), h))
            plain = [x for x in taken if not re.search(rf" ({no})( (t|yet|been|being|currently))? $", " " + b" ".join([*tokens[:x[0][0]], b""]).decode())]
            whole = model.judge(tokens, 0.5, 0.4) if tokens else None
            if whole and any(h[0] == whole[0] for _, h in taken) and not any(h[0] == whole[0] for _, h in plain):
                whole = None
            for (i, j), h in plain:
                rest = model.judge(tokens[:i] + tokens[j:], 0.5, 0.4) if whole else None
                if not whole or h[0] == whole[0] or (rest and rest[0] == whole[0]):
                    out.add(h[0])
            out |= {whole[0]} if whole else set()
        return sorted(out)

    got = {r.doc_id: r.notices for r in license_scan.notices(frame, model).collect()}
    assert {i: sorted({n.family for n in got[i]}) for i, _ in texts} == {i: families(t) for i, t in texts}


# toxicity: the filter against the scores

def test_filter_keeps_what_the_scores_leave(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [(i, " ".join([word() for _ in range(30)] + ["vile rotten"] * (3 if i % 4 == 0 else 0)), i % 4 == 0) for i in range(300)]
    rows = [(i, t, 1.0, "x") for i, t, _ in texts] + [(1000, None, 1.0, "x"), (1001, "", 1.0, "x"), (4, texts[4][1], 1.0, "x"), (5, texts[5][1], 1.0, "x"), (1002, "clean " * 200_000, 1.0, "x"), (1003, "clean " * 200_000 + "vile rotten " * 500, 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity double, toxic string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in texts], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    scored = toxicity.severity(docs.drop("severity", "toxic"), toxicity.fit(docs, labels)).collect()
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(r.doc_id for r in scored if not r.toxic)
    assert ids.count(5) == 2 and 4 not in ids and {1000, 1001, 1002} <= set(ids) and 1003 not in ids
    as_severity = toxicity.severity(docs.drop("severity").withColumn("toxic", docs.text).drop("text"), toxicity.fit(docs, labels), text="toxic")
    assert sorted(r.severity for r in as_severity.collect()) == sorted(r.severity for r in scored)


# chat

def test_snapshots_collapse(spark):
    say = lambda c, texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = say(1, ["a", "b"]) + say(2, ["a", "b", "c", "d"]) + say(3, ["a", "b", "c", "d"]) + say(4, ["a", "x"]) + say(5, ["a", "b", "c", "e"])
    rows += say(6, ["q", None]) + say(7, ["q", ""]) + [(8, None, None, None), (9, 0, "user", "t"), (9, 0, "user", "t"), (9, 0, "tool", "t")] + [(None, 0, "user", "n")]
    rows += say(10, [f"t{i}" for i in range(300)]) + say(11, [f"t{i}" for i in range(150)])
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r for r in rows])
    got = sorted((str(tuple(r)) for r in chat.render(frame).collect()))
    want = sorted(str(r) for r in con.execute(chat.SQL.replace("order by turn, role, text", "order by turn nulls first, role nulls first, text nulls first")).fetchall())
    assert got == want
    assert {r.conv_id for r in chat.render(frame).collect()} == {2, 4, 5, 6, 7, 8, 9, None, 10}
    assert chat.render(frame.limit(0)).count() == 0


def test_pieces_join_to_the_whole(spark):
    rows = [(c, i, "user", f"{c} {i} " + "x" * (i % 7)) for c in (1, 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r.text for r in chat.render(frame).collect()}
    pieces = sorted(((r.conv_id, r.piece, r.text) for r in chat.render(frame, piece=300).collect()))
    assert len(pieces) > 20
    for c in (1, 2):
        assert "".join(t for k, _, t in pieces if k == c) == whole[c] == "".join(f"<|user|>\n{t}\n<|end|>\n" for k, _, _, t in rows if k == c)


# toxicity

def test_severity_is_learnt_and_ordered(spark):
    rng = random.Random(6)
    plain, bad = ["".join(rng.choices("klmnopqr", k=5)) for _ in range(200)], ["nasty", "vile", "awful", "rotten"]
    rows, labels = [], []
    for i in range(600):
        n = rng.choice([0, 0, 0, 2, 4, 8])
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))] + [rng.choice(bad) for _ in range(n)]
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize(), 0.5))
        labels.append((i, int(n > 0)))
    labels += [(None, 1), (5, None), (7, labels[7][1])]
    docs = spark.createDataFrame([*rows, (1000, None, 0.1), (1001, "", 0.1)], "doc_id long, text string, severity double")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), max_labels=400)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    truth = dict(labels[:600])
    assert np.mean([got[i].toxic == bool(truth[i]) for i in truth]) > 0.97
    assert all(abs(sum(r.p_at_least) - r.severity) < 1e-9 and r.p_at_least == sorted(r.p_at_least, reverse=True) for r in got.values())
    assert not got[1000].toxic and got[1000].severity == got[1001].severity
    scores = [toxicity.severity(spark.createDataFrame([(1, "klm " + "vile " * k)], "doc_id long, text string"), model).first().severity for k in (0, 1, 3, 9)]
    assert scores == sorted(scores)
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns and 1000 in {r.doc_id for r in kept.collect()}


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1)]):
        assert toxicity.drop_toxic(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).count() == 2


def test_ordinal_weights_recover_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 1))
    grade = np.digitize(2 * x[:, 0] + rng.logistic(size=800), [-1, 1, 3])
    w, theta = toxicity.ordinal_fit(np.arange(800), np.zeros(800, int), x[:, 0], grade, 1, 3)
    assert abs(w[0] - 2) < 0.4 and np.allclose(theta, [-1, 1, 3], atol=0.5)


# top-k

@pytest.mark.parametrize("block,queries", [(8192, 512), (50, 7)])
def test_top_k_equals_sql(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(scale=0.2, size=16).astype(np.float32)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 420)] + [(420, [0.0] * 16), (421, None), (422, [1.0, None] + [0.0] * 14), (423, [float("nan")] * 16), (424, [float("inf")] * 16), (425, [1.0] * 16), (425, [1.0] * 16)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", [r for r in rows[:-1]])
    got = sorted(map(tuple, topk.search(frame, frame.where("vec_id % 50 = 0")).collect()))
    assert got == sorted(con.execute(topk.SQL).fetchall())
    assert topk.search(frame.limit(0), frame.limit(0)).count() == 0
    assert topk.search(frame.where("vec_id < 3"), frame.where("vec_id = 0")).count() == 2


# components

def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert {n: got.get(n, n) for n in low} == low
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# registered queries and pipeline

def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) < set(QUERIES)


def test_pipeline_by_brute_force(spark):
    """The stages' own guarantees, each on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        if name != "bpe":
            assert out.columns == columns
        out = corpus_pipeline.stage(out, "test-pipeline")
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count() and set(rows) <= set(before)
        if name == "line_dedup":
            for i, r in rows.items():
                assert r.text == before[i] or len(r.text.split("\n")) < len(before[i].split("\n"))
        elif name == "bpe":
            assert set(rows) == set(before) and all(r.n_tokens == len(r.ids) for r in rows.values())
        else:
            assert all(r.text == before[i] for i, r in rows.items())
        before = {i: r.text for i, r in rows.items()} if name != "bpe" else before
        docs = out
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {i: r.n_tokens for i, r in rows.items()}


def test_near_dedup_stage_by_brute_force(spark):
    """Classes by 5-word Jaccard of 0.8 or more: pairs far apart in SimHash bits, a large
    group of near copies, repeated and null ids; of each class the first row stays."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for i in range(120):
        base = [word() for _ in range(rng.randrange(3, 200))]
        rows.append((3 * i, " ".join(base)))
        for k in range(rng.randrange(3)):
            copy = [w if rng.random() > 0.02 * (k + 1) else word() for w in base]
            rows.append((rng.choice([3 * i + 1 + k, 3 * i, None]), " ".join(copy)))
    group = [word() for _ in range(120)]
    rows += [(2000 + i, " ".join(group[:i] + ["changed"] + group[i + 1:])) for i in range(120)]
    rows += [(None, "same text"), (None, "Same  text"), (5000, None), (5001, ""), (5002, " \n"), (7, "one of two texts"), (7, "that share a key")]
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(rows)))
    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                low[max(root(i), root(j))] = min(root(i), root(j))
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(root(i), []).append(i)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, other int")
    out = corpus_pipeline.near_dedup(spark, frame, SF)
    assert out.columns == frame.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(classes) < len(rows) - 150
    where = {r: i for i, r in enumerate(rows)}
    assert len({root(where[r]) for r in got}) == len(got)
    first = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    for r in got:
        assert first(where[r]) == min(map(first, classes[root(where[r])]))
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), SF).count() == 0


def test_boilerplate_makes_no_pairs_and_a_map_column_is_kept(spark, monkeypatch):
    """Texts that share most of their words but are not near copies are not compared with each other: the
    candidates grow with the texts, not with their square."""
    rng = random.Random(5)
    frame = ["page", *[f"menu{i}" for i in range(60)]]
    compared = []
    alike = near_dedup._alike
    monkeypatch.setattr(near_dedup, "_alike", lambda pairs, *a: (compared.append(pairs.count()), alike(pairs, *a))[1])
    for size in (100, 400):
        texts = [" ".join(frame + [f"own{rng.randrange(10 ** 9)}" for _ in range(40)]) for _ in range(size)]
        docs = spark.createDataFrame([(i, t, {"k": i}) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, props map<string,int>")
        compared.clear()
        assert sorted(r.doc_id for r in near_dedup.keep_first(docs).collect()) == list(range(size))
        assert sum(compared) <= size


def test_near_duplicates_of_a_table_of_files_need_no_copy_of_it(spark, tmp_path, monkeypatch):
    words = lambda i, n=40: " ".join(f"w{(i * 31 + j) % 5003}" for j in range(n))
    rows = [(i, words(i // 3 * 50 + i % 3 // 2), "en") for i in range(60)] + [(None, words(7), "fr"), (3, words(50), "de"), (61, None, "en"), (62, " ", "en")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    frame.repartition(5, "doc_id").write.parquet(str(tmp_path / "docs.parquet"))
    names, real = [], near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, name, **more: names.append(name) or real(df, name, **more))
    copied = sorted(map(tuple, near_dedup.keep_first(frame).collect()), key=str)
    assert "near-source" in names
    names.clear()
    table = spark.read.parquet(str(tmp_path / "docs.parquet"))
    assert sorted(map(tuple, near_dedup.keep_first(table).collect()), key=str) == copied and len(copied) < len(rows) - 10
    assert "near-source" not in names
    # Rows of one place, as of an exploded table, are not told apart by it.
    assert near_dedup.keep_first(table.union(table)).count() == len(copied)
    assert near_dedup.keep_first(table.selectExpr("*", "explode(array(1, 2)) as k")).count() == len(copied)
