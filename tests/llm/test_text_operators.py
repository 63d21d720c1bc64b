"""Operators on texts against brute force on small tables: nulls, empty texts, ties, repeated rows, empty
tables and extra columns included."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from palimpsest.llm import bpe, decontaminate, line_dedup, lm, simhash

DOCS = "doc_id long, text string, row string, keep int, fp long, n_words int, key string, ids string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 7, 8, 9, "k", "x") for i, t in rows], DOCS)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", fold(text)) if w]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "ÜBER", "a,b", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60))) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1] + " w1"), (42, None), (43, ""), (44, " \n\t"), (3, rows[3][1]), (None, text(30)), (45, text(3000))]
    return rows


# decontamination

def test_contamination_equals_sql(spark, corpus):
    items = [(1, corpus[0][1]), (2, corpus[1][1][:30]), (2, "w1 w2"), (10, "w5"), (11, None), (12, ""), (13, corpus[0][1]), (14, "W1 W1")]
    frame = docs(spark, [r for r in corpus if r[0] is not None])
    got = decontaminate.report(frame, spark.createDataFrame(items, "item_id long, text string"))
    con = duckdb.connect()
    documents, benchmark = frame.select("doc_id", "text").toPandas(), spark.createDataFrame(items, "item_id long, text string").toPandas()  # noqa: F841
    con.execute("create table documents as select cast(doc_id as bigint) doc_id, text from documents")
    con.execute("create table benchmark as select cast(item_id as bigint) item_id, text from benchmark")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(decontaminate.SQL).fetchall())


def test_contamination_in_blocks_is_the_same(spark, corpus):
    frame, items = docs(spark, corpus), spark.createDataFrame([(i, t) for i, t in corpus[:6]], "item_id long, text string")
    want = decontaminate.contamination(frame, items).select("doc_id", "n_hit", "n_items").collect()
    got = decontaminate.contamination(frame, items, block=3).select("doc_id", "n_hit", "n_items").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r.n_hit for r in got)


def test_contamination_of_nothing(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs(spark, []), none).count() == 0
    rows = decontaminate.report(docs(spark, corpus), none).collect()
    assert len(rows) == len(corpus) and not any(r.contaminated for r in rows)
    kept = decontaminate.drop_contaminated(docs(spark, corpus), spark.createDataFrame([(1, corpus[0][1])], "item_id long, text string"))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert 0 not in {r.doc_id for r in kept.collect()} and kept.count() < len(corpus)


# simhash

def print_of(text):
    w = space_words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, ids, bits):
    low = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= bits and low[j] < low[i]:
                    low[i], changed = low[j], True
    return [min((ids[j] for j in range(len(ids)) if low[j] == low[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_near_duplicates_equal_brute_force(spark, corpus):
    rng, base = random.Random(3), corpus[45 - 40 + 2][1].split()
    near = [(100 + i, " ".join(base[:rng.randrange(len(base))] + ["zz"] + base[rng.randrange(len(base)):])) for i in range(20)]
    long = corpus[-1][1].split()
    near += [(200 + i, " ".join(long[:i * 20] + ["changed"] + long[i * 20 + 1:])) for i in range(60)]
    rows = corpus + near
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints, ids = [print_of(t) for _, t in rows], [i for i, _ in rows]
    want = zip(ids, [f"{p:016x}" for p in prints], classes(prints, ids, 4))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len({r.component_id for r in got}) < len(rows) - 40


def test_every_pair_within_the_distance_shares_a_variant(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for x in base for _ in range(4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in {*base, *near}]
    got = {frozenset((r.a, r.b)) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert got == want


def test_a_long_run_keeps_its_classes(spark):
    rng = random.Random(9)
    x, chain = rng.getrandbits(64), set()
    for _ in range(150):  # a walk: neighbours are near, ends are far apart
        for b in rng.sample(range(24, 64), 2):
            x ^= 1 << b
        chain.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in chain]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    seen, todo = set(), [signed[0]]
    near = {}
    for r in links:
        near.setdefault(r.a, []).append(r.b)
        near.setdefault(r.b, []).append(r.a)
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += near.get(v, [])
    assert seen == set(signed)


def test_keep_first_keeps_one_of_each_class_and_all_columns(spark, corpus):
    frame = docs(spark, corpus)
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns and simhash.keep_first(docs(spark, [])).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 40 not in ids and None in ids and [i for i in ids if i in (42, 43, 44)] == [42]


# language model

def test_base_scores_and_mixture(spark, corpus):
    rows = corpus * 3
    got = lm.score(docs(spark, rows), tokens=200).collect()
    counts, tokens = Counter(), {}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    for i, t in rows:
        if held(i):
            counts.update([*space_words(t), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i) == 0, len(space_words(t)) + 1, sum(counts[w] > 0 for w in [*space_words(t), "\n"]), total,
                   round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*space_words(t), "\n"]), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_is_a_distribution_and_weights_follow_the_data(spark):
    """Probabilities after one predecessor sum to one over the vocabulary and one unknown word."""
    rows = [(i, "a b a b a c") for i in range(200)]
    got = {r.doc_id: r for r in lm.score(docs(spark, rows + [(1000 + i, w) for i, w in enumerate(["a", "b", "c", "zz"])])).collect()}
    assert got[0].score > got[0].base_score  # pairs tell more than words
    first = [10 ** got[1000 + i].score for i in range(4)]
    assert sum(first) < 1 and first[0] > first[1] > 0


def test_weights_find_a_planted_mixture():
    import numpy as np
    cells = np.array([[3, 0, -1, 900], [3, 1, 5 * lm.FINE, 100]])
    lam = lm.weights(cells, 1000, 50)
    assert lam[3][0] > 0.8 and abs(lam.sum(axis=1) - 1).max() < 1e-9 and lam[0][0] == 0


def test_scores_of_nothing(spark):
    assert lm.score(docs(spark, [])).count() == 0


# line dedup

LONG = [" ".join(f"l{k}w{i}" for i in range(30)) for k in range(8)]


def test_blocks_go_from_the_later_document(spark):
    rows = [(1, "\n".join(LONG[:4])), (2, "mine\n" + "\n".join(LONG[1:3]) + "\nown"), (3, "\n".join([LONG[2], "between", LONG[0]])),
            (4, "short line\n\nmine\nown"), (5, None), (6, ""), (7, LONG[5] + "\n" + LONG[5]), (8, "x\n" + LONG[5] + "\ny"),
            (9, "\n".join(LONG[:4])), (9, "\n".join(LONG[:4])), (None, LONG[7]), (10, LONG[7] + " \n  "), (11, LONG[3].replace("l3w4", "other"))]
    frame = docs(spark, rows)
    out = line_dedup.dedup_lines(frame)
    assert out.columns == [*frame.columns, "n_removed_lines", "n_removed_words"]
    got = sorted(((r.doc_id, r.text, r.n_removed_lines) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1], 0), (2, "mine\nown", 2), (3, "between", 2), (4, rows[3][1], 0), (5, None, 0), (6, "", 0), (7, rows[6][1], 0),
                          (8, "x\ny", 1), (9, "", 4), (9, "", 4), (None, LONG[7], 0), (10, "  ", 1), (11, rows[12][1], 0)], key=str)


def test_runs_of_short_lines_are_found(spark):
    lines = [f"a{i} b{i} c{i}" for i in range(12)]
    rows = [(1, "\n".join(["start", *lines])), (2, "\n".join(["other", *lines[:10], "end"])), (3, "\n".join(lines[:6]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[2] == "other\nend" and got[3] == rows[2][1]  # 18 words are no block


def test_patience_aligns_like_the_longest_chain_of_unique_lines():
    assert line_dedup.patience([1, 2, 3, 4], [0, 2, 3, 9, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([5, 5, 5], [5, 5]) == [(0, 0), (1, 1)]
    assert line_dedup.patience([1, 7, 7, 2], [7, 1, 2, 7]) in ([(0, 1), (3, 2)], [(0, 1), (1, 3)])
    assert line_dedup.patience([], [1]) == []
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(12))] for _ in range(2))
        p = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))


def test_a_copy_of_every_deleted_line_stays_earlier(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(LONG) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randrange(1, 7)))) for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    seen = set()
    for i, text in rows:
        left = Counter(x for x in got[i].split("\n"))
        for line, n in Counter(text.split("\n")).items():
            assert left[line] == n or line in seen
        seen |= set(got[i].split("\n"))
        if i:
            assert not any(line in earlier for line in left if len(line) > 40 for earlier in [set(x for k in range(i) for x in got[k].split("\n"))])


def test_blocks_in_another_order_go_whatever_the_short_lines(spark):
    short = [f"short {i}" for i in range(9)]
    rows = [(1, "\n".join([LONG[0], "licence"])), (2, "\n".join(["licence", LONG[0]])), (3, "\n".join(["note", LONG[1]])), (4, "\n".join([LONG[1], "note"])),
            (5, "\n".join([LONG[2], LONG[3], *short])), (6, "\n".join([*short, LONG[2], LONG[3]]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "licence", 3: rows[2][1], 4: "note", 5: rows[4][1], 6: "\n".join(short)}


def test_no_shared_run_is_left_after_an_alignment():
    rng = random.Random(12)
    for _ in range(4000):
        top = rng.randrange(2, 12)
        early, late = ([rng.randrange(top) for _ in range(rng.randrange(14))] for _ in range(2))
        weight = [rng.randrange(1, 12) for _ in range(top)]
        words, free = [weight[x] for x in late], [True] * len(late)
        taken = line_dedup.common_blocks(early, late, words, free, 20)
        assert sorted(taken) == [j for j, ok in enumerate(free) if not ok] and all(late[j] in early for j in taken)
        inside = {tuple(early[i:k]) for i in range(len(early)) for k in range(i + 1, len(early) + 1)}
        for i in range(len(late)):
            for k in range(i + 1, len(late) + 1):
                assert not (all(free[i:k]) and sum(words[i:k]) >= 20 and tuple(late[i:k]) in inside)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# tokenizer

@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_automaton_equals_the_library(library):
    rng = random.Random(11)
    encoder = bpe.Tokenizer(bpe.default_path()).encoder()
    alphabet = "aaabcdehilnoprst '.,!019éßΣİσÄ\u0301\x1c\x85\u3000中🙂\n\tABC"
    parts = ["a", "aa", "s", "t", "th", "e", "in", "!", "!!", "the", "an", "0", "ha", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "|>"]
    for k in range(4000):
        text = "".join(rng.choice(parts if k % 2 else alphabet) for _ in range(rng.randrange(25)))
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_every_pair_of_merges_in_order():
    """A small rule set with overlaps, against merging step by step."""
    merges = [("a", "b"), ("b", "c"), ("a", "a"), ("ab", "c"), ("aa", "b"), ("b", "b"), ("bb", "bb"), ("c", "ab")]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", *[x + y for x, y in merges]])}
    machine = bpe.Automaton(vocab, merges)
    top = machine.spelling()

    def by_hand(word):
        word = list(word)
        for x, y in merges:
            i = 0
            while i + 1 < len(word):
                if (word[i], word[i + 1]) == (x, y):
                    word[i:i + 2] = [x + y]
                i += 1
        return [vocab[t] for t in word]

    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        assert machine.encode(word, top) == by_hand(word), word


def test_digests_and_round_trip(spark, corpus, library):
    rows = [*corpus, (46, "Hello <|endoftext|> World's 12 ÉTÉ!! \x1c x" * 3)]
    got = {str(tuple(r)) for r in bpe.digests(docs(spark, rows), bpe.load(spark)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add(str((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))))
    assert got == want
    assert bpe.digests(docs(spark, []), bpe.load(spark)).count() == 0
    coded = bpe.decode(bpe.encode(docs(spark, rows), bpe.load(spark)), bpe.load(spark))
    assert sorted(sha(r.decoded) for r in coded.collect()) == sorted(sha(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for _, t in rows)
    assert bpe.encode(docs(spark, rows), bpe.load(spark)).columns == [c for c in docs(spark, []).columns if c not in ("ids", "text")] + ["ids"]
