"""The operators on texts against plain Python, with nulls, empty and very long texts, repeats and clashing names."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hashing, leaks, packing, shared_spans

WORDS = "river lamp stone quiet orange meter bucket seven garden willow copper signal paper window anchor violet tunnel maple harbor cinder".split()


def documents(spark, texts, **extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for name in ("n_tokens", "part", "anchor", "place", "shingle", "first", "todo"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


# -- packing


def lower_bound(sizes, capacity):
    return -(-sum(sizes) // capacity)


def check_patterns(counts, patterns, capacity):
    used = np.zeros_like(counts)
    for times, parts in patterns:
        assert times > 0 and sum(s * k for s, k in parts) <= capacity
        for s, k in parts:
            used[s] += times * k
    assert (used[1:] == counts[1:]).all()


def fewest(sizes, capacity):
    """The least number of containers, by trying everything."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= sizes[i]}):
            rooms.remove(r)
            rooms.append(r - sizes[i])
            place(i + 1, rooms)
            rooms.remove(r - sizes[i])
            rooms.append(r)
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_dominance_never_costs_a_container(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 13, 20])
    sizes = sorted((rng.randint(1 if seed % 2 else capacity // 5, capacity) for _ in range(9)), reverse=True)
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    left = counts.copy()
    fixed = packing.reduce_by_dominance(left, capacity)
    rest = [s for s in range(capacity, 0, -1) for _ in range(left[s])]
    assert sum(t for t, _ in fixed) + fewest(rest, capacity) == fewest(sizes, capacity)
    check_patterns(counts, packing.pack_sizes(counts, capacity), capacity)


@pytest.mark.parametrize("capacity", [100, 2048])
def test_packing_leaves_little_room(capacity):
    rng = random.Random(capacity)
    sizes = [min(capacity, max(1, int(rng.lognormvariate(capacity / 400 + 2, 1)))) for _ in range(5000)]
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    patterns = packing.pack_sizes(counts, capacity)
    check_patterns(counts, patterns, capacity)
    assert sum(t for t, _ in patterns) <= lower_bound(sizes, capacity) * 1.02 + 1
    assert len(patterns) < 4 * capacity


def test_many_equal_pieces_make_few_patterns():
    counts = np.zeros(2049, np.int64)
    counts[[2048, 700, 3]] = 10**12, 3 * 10**12 + 1, 5
    patterns = packing.pack_sizes(counts, 2048)
    check_patterns(counts, patterns, 2048)
    assert len(patterns) < 9


@pytest.mark.parametrize("rows_per_task", [2_000_000, 7])
def test_every_text_has_its_place(spark, rows_per_task):
    sizes = [0, 5000, 2048, 2049, 10, 10, 10, 10, 2038, 0, 700, 700, 1] + [3] * 100
    tokens = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint").withColumn("salt", F.lit("clash"))
    got = packing.assign_containers(tokens, 2048, rows_per_task).collect()
    assert len(got) == len({(r["doc_id"], r["part"]) for r in got})
    for doc, size in enumerate(sizes):
        parts = sorted((r["token_from"], r["n_tokens"]) for r in got if r["doc_id"] == doc)
        assert sum(n for _, n in parts) == size and len(parts) == max(1, -(-size // 2048))
        assert [a for a, _ in parts] == [2048 * i for i in range(len(parts))]
    loads = {}
    for r in got:
        loads[r["container_id"]] = loads.get(r["container_id"], 0) + r["n_tokens"]
    assert max(loads.values()) <= 2048 and len(loads) == lower_bound(sizes, 2048)
    assert packing.assign_containers(tokens.where("false")).count() == 0


def test_token_counts(spark):
    texts = ["hello world", "", None, "<|endoftext|>", "a" * 1_000_000, "naïve 日本語 \U0001f600", " " * 300_000, "ab " * 200_000, "x" + " \n" * 40_000 + " y"]
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(documents(spark, texts)).collect()}
    assert (got[0], got[1], got[2]) == (2, 0, 0)
    whole = packing._encoder(packing.VOCABULARY)
    assert got[3] > 1 and got[5] > 4 and got[6] > 0
    assert got[4] == len(whole.encode_ordinary(texts[4])) and got[7] == len(whole.encode_ordinary(texts[7]))
    assert got[8] == len(whole.encode_ordinary("x")) + len(whole._encode_single_piece(" \n" * 40_000)) + len(whole.encode_ordinary(" y"))


def test_pieces_are_those_of_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "BLANKS", 3)
    encoder = packing._encoder(packing.VOCABULARY)
    for text in ("a   b", "  x\n\n\n y 12 don't", "\t\t\t", "日本   語!!  ", "a    "):
        assert packing.count_tokens(text, encoder) == len(encoder.encode_ordinary(text))


# -- shared stretches


def brute_stretches(texts, span):
    """Every window beside its reference's first place, extended both ways."""
    holders = {}
    for i, t in enumerate(texts):
        for at in range(len(t or "") - span + 1):
            holders.setdefault(t[at : at + span], {}).setdefault(i, at)
    out = set()
    for i, t in enumerate(texts):
        for at in range(len(t or "") - span + 1):
            held = holders[t[at : at + span]]
            if len(held) > 1:
                other = max(held) if i == min(held) else min(held)
                a, b, u, n = at, held[other], texts[other], span
                while a and b and t[a - 1] == u[b - 1]:
                    a, b, n = a - 1, b - 1, n + 1
                while a + n < len(t) and b + n < len(u) and t[a + n] == u[b + n]:
                    n += 1
                out.add((i, a, n, other, b))
    return sorted(out)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def check_stretches(spark, texts, span):
    got = shared_spans.shared_stretches(documents(spark, texts), span).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["other"], r["other_start"]) for r in got) == brute_stretches(texts, span)
    for r in got:
        stretch = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["other"] != r["doc_id"] and stretch == texts[r["other"]][r["other_start"] :][: r["length"]]
        assert r["class_id"] == min(r["doc_id"], r["other"])
    return got


def test_stretches_shared_with_different_documents_are_not_chained(spark):
    rng = random.Random(5)
    a, noise = prose(rng, 100)[:400], [prose(rng, 40) for _ in range(3)]
    for texts in ([a, noise[0] + "#" + a[:250] + "#" + noise[1], "#" + a[100:400] + "#" + noise[2]], ["#" + a[:250] + "#", "#" + a[100:400] + "#", a]):
        got = check_stretches(spark, texts, 150)
        whole = texts.index(a)
        assert sorted((r["start"], r["length"]) for r in got if r["doc_id"] == whole) == [(0, 250), (100, 300)]
        assert {r["other"] for r in got if r["doc_id"] == whole} == {0, 1, 2} - {whole}


def test_no_link_is_lost(spark):
    """Any two documents that share a window meet at the same place of one document."""
    rng = random.Random(15)
    source = prose(rng, 200)
    texts = [prose(rng, 10) + source[a : a + rng.randint(150, 500)] + prose(rng, 10) for a in (rng.randrange(900) for _ in range(25))]
    texts += [texts[3], texts[3], source[:700]]
    lines = defaultdict(list)
    for r in check_stretches(spark, texts, 150):
        lines[r["doc_id"]].append((r["other"], r["other_start"], r["length"], r["start"]))
    first = defaultdict(dict)
    for i, t in enumerate(texts):
        for at in range(len(t) - 149):
            first[t[at : at + 150]].setdefault(i, at)
    for held in first.values():
        low = min(held)
        for i in list(held)[1:]:
            assert any(o == low and b <= held[low] and held[low] + 150 <= b + n for o, b, n, _ in lines[i])


@pytest.mark.parametrize("limits", [(100_000, 100_000), (3, 1000)])
def test_frequent_stretches_are_spread(spark, monkeypatch, limits):
    monkeypatch.setattr(shared_spans, "HOT_ROWS", limits[0])
    monkeypatch.setattr(shared_spans, "HOT_KEYS", limits[1])
    rng = random.Random(16)
    notice = prose(rng, 40)
    texts = [prose(rng, 5) + notice[: rng.randint(150, len(notice))] + prose(rng, 5) for _ in range(30)] + [notice] * 10
    assert check_stretches(spark, texts, 150)


@pytest.mark.parametrize("seed", range(4))
def test_stretches_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, 60) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            source = rng.choice(pool)
            a = rng.randrange(len(source) - 130)
            parts += [source[a : a + rng.choice([118, 119, 120, 121, 122, 150, 200, 300])], prose(rng, rng.randint(0, 12))]
        texts.append("".join(parts))
    assert check_stretches(spark, texts, 120)


def test_stretches_with_odd_span_and_edges(spark):
    base = prose(random.Random(9), 40)
    texts = [base[:151], base[:151], base[:150], "x" + base[:150], base[1:152], None, "", "short", base[:149] + "é", "é" * 200, "é" * 200, "\U0001f600" * 151, "y\U0001f600" * 80]
    for span in (150, 151, 149):
        check_stretches(spark, texts, span)


def test_a_text_that_repeats_itself_shares_nothing(spark):
    block = prose(random.Random(8), 40)
    assert check_stretches(spark, [block + block, prose(random.Random(7), 40)], 150) == []
    assert check_stretches(spark, [block + block, block, "a" * 400], 150)


def test_stretches_of_hot_and_long_texts(spark):
    rng = random.Random(6)
    notice = prose(rng, 30)
    texts = [prose(rng, 20) + notice + prose(rng, 20) for _ in range(60)] + [notice] * 30 + [prose(rng, 60_000) + notice]
    got = shared_spans.shared_parts(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    assert all(r["shared_chars"] >= len(notice) and r["stretches"] >= 1 and r["links"] >= 1 for r in got)
    assert all(r["n_chars"] == len(texts[r["doc_id"]]) for r in got)


def test_no_texts(spark):
    df = documents(spark, ["a"]).where("false")
    assert shared_spans.shared_stretches(df).count() == 0 == shared_spans.shared_parts(df).count()


def test_sliding_minimum_and_hashes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for width in (1, 2, 7, 999, 1000):
        assert (hashing.sliding_min(x, width) == [x[i : i + width].min() for i in range(1000 - width + 1)]).all()
    text = hashing.code_points("abcabcabc" * 50)
    prefix = hashing.prefix_hash(text)
    same = hashing.stretch_hash(prefix, np.array([0, 3, 6, 1]), np.array([30, 33, 36, 31]))
    assert same[0] == same[1] == same[2] != same[3]


# -- leaks


def leak_ids(spark, texts, passages, **kw):
    items = spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "item_id bigint, passage string").withColumn("text", F.lit("clash")).withColumn("doc_id", F.lit(7))
    return sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(documents(spark, texts), items, **kw).collect())


def changed(rng, words, every):
    return [rng.choice(["zebra", "", "extra " + w]) if i % every == every // 2 else w for i, w in enumerate(words)]


def sentence(rng, n):
    return [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]


def test_leaks_whole_in_part_and_changed(spark):
    rng = random.Random(11)
    passages = [" ".join(sentence(rng, n)) for n in (90, 60, 40, 30, 25)]
    noise = lambda n: " ".join(sentence(rng, n))
    texts, expected = [], []

    def add(text, *items):
        expected.extend((len(texts), i) for i in items)
        texts.append(text)

    for i, p in enumerate(passages):
        w = p.split()
        add(f"{noise(50)} {p} {noise(50)}", i)
        add(p.upper() + noise(30), i)
        add("> " + "\n> ".join(" ".join(w[k : k + 7]) + "," for k in range(0, len(w), 7)), i)
        add(f"<p>{noise(9)}</p><blockquote>{' <b>'.join(w)}</blockquote>", i)
        add(f"{noise(40)} {' '.join(w[-27:])}", i)
        add(f"{' '.join(w[:26])} {noise(40)}" if len(w) > 25 else p, i)
        add(f"{noise(5)} {' '.join(w[:14])} {noise(5)}")
        add(" ".join(changed(rng, w, 3)))
        if len(w) >= 40:
            add(f"{noise(20)} {' '.join(changed(rng, w, 9))} {noise(20)}", i)
    add(passages[0] + " " + noise(9) + " " + passages[3], 0, 3)
    add(noise(30_000) + " " + passages[1], 1)
    add(None)
    add("")
    assert leak_ids(spark, texts, passages) == sorted(expected)


def test_leaks_of_nothing_and_repeats(spark):
    rng = random.Random(12)
    p = " ".join(sentence(rng, 40))
    assert leak_ids(spark, [p, p, "x"], [p, p, None, "", "too short"]) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert leak_ids(spark, [p], [None]) == []
    assert leak_ids(spark, [None], [p]) == []


def test_both_ways_of_joining_agree(spark, monkeypatch):
    rng = random.Random(13)
    passages = [" ".join(sentence(rng, 50)) for _ in range(5)]
    texts = [" ".join(sentence(rng, 30)) + " " + " ".join(changed(rng, rng.choice(passages).split(), 10)) for _ in range(20)]
    small = leak_ids(spark, texts, passages)
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 0)
    assert leak_ids(spark, texts, passages) == small and len(small) == 20


def test_words():
    assert leaks.words_of("A &amp; [b]B[/b]-c <a href='x'>d</a>&lt;i&gt; e_f") == ["a", "b", "c", "d", "e", "f"]


def test_longest_passage():
    item = [f"w{i}" for i in range(60)]
    for a, b in itertools.product((0, 5, 20), (30, 45, 60)):
        n = leaks.longest_passage(item, ["x"] * 9 + item[a:b] + ["y"] * 9, 25, 8)
        assert n == 0 if b - a < 20 else n >= b - a or b - a < 25


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(before + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_longest_passage_tries_all_alignments(seed):
    rng = random.Random(seed)
    item = [rng.choice("abcdef") for _ in range(12)]
    text = [w for w in item[rng.randrange(3) :] if rng.random() < 0.9 for w in ([w] if rng.random() < 0.8 else [rng.choice("abcdef"), w])]
    best = 0
    for i, j in itertools.combinations(range(len(item) + 1), 2):
        if j - i >= 5:
            least = min(edits(item[i:j], text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
            best = max(best, j - i if least <= leaks.allowed(j - i, 4) else 0)
    assert leaks.longest_passage(item, text, 5, 4) == best
    shift = rng.randrange(-3, 3)
    assert leaks.longest_passage(item, text, 5, 4, (shift, shift)) <= best == leaks.longest_passage(item, text, 5, 4, (-12, 20))


def test_levels():
    assert leaks.levels(25, 8) == [(25, 3, 6), (28, 4, 4), (36, 5, 7), (44, 6, 10)]
    with pytest.raises(ValueError):
        leaks.levels(10, 3)


@pytest.mark.parametrize("places", [(5, 11, 17, 23), (4, 9, 14, 19, 24, 29, 34), (2, 8, 14, 20), (6, 12, 18, 22)])
def test_the_filter_loses_nothing_that_the_verifier_accepts(spark, places):
    """Changes where they destroy the most shingles, in passages of the least length for so many."""
    rng = random.Random(sum(places))
    size = 28 if len(places) == 4 else 52
    words = sentence(rng, size)
    text = [rng.choice(["", f"new{i}", f"{w} more"]) if i in places else w for i, w in enumerate(words)]
    assert leaks.longest_passage(words, leaks.words_of(" ".join(text)), 25, 8)
    noise = lambda n: " ".join(sentence(rng, n))
    frequent = [" ".join(words[a : a + 12]) + noise(30) for a in range(size - 12) for _ in range(3)]  # no shingle is rare
    got = leak_ids(spark, [f"{noise(40)} {' '.join(text)} {noise(40)}", noise(50), *frequent], [" ".join(words), noise(40)])
    assert got == [(0, 0)]


def test_long_tags_are_markup():
    assert leaks.words_of(f"<a href='{'x' * 900}'>b</a> [url={'y' * 300}]c[/url]") == ["b", "c"]
