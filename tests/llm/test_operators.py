"""Operators against brute force on a small table and on edge rows."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skysift.llm import licenses, line_dedup, materialise, mixing, near_dedup, neighbours, packing, pages, quality, substring_dedup
from skysift.llm.queries import vocabulary
from skysift.session import TableStore

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, size int, shard int, _k int, n_lines int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def edges(spark):
    base = " ".join(f"word{i}x" for i in range(80))
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n\x0b", None, "b"), (4, "one", "en", "a"), (5, "a b c d", "en", "a"), (6, base, "en", "a"), (7, base, "en", "a"),
        (7, base, "en", "a"), (8, base + " tail", "de", "b"), (None, base, "en", "a"), (None, "other text", None, None), (9, "é x\xa0y ß日本 😀\x1cz", "en", "c"),
        (10, ("long " * 3 + "x\n") * 9000, "en", "a"), (11, "A b c D", "en", "z"), (12, "<|endoftext|> it's 12%", "en", "a"), (13, "x" * 70000, "en", "d"),
    ]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "k", 1, 2, 3, 4) for i, t, la, s in rows], DOCS)


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, budget, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("which", ["documents", "edges"])
def test_mixing(spark, request, which):
    docs = request.getfixturevalue(which)
    rows = mixing.shares(docs, TableStore(spark)).collect()
    source = docs.select("doc_id", "text", "source").collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(words(r.text))) for r in source)
    sizes = Counter()
    for r in source:
        sizes[r.source] += len(words(r.text))
    wanted = targets_by_hand(sizes)
    by_id = {r.doc_id: r.source for r in source if r.doc_id is not None}
    got = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        if r.doc_id is not None:
            s = by_id[r.doc_id]
            assert r.source_size == sizes[s] and math.isclose(r.target, wanted[s], rel_tol=1e-9, abs_tol=1e-9)
            got[s] += r.taken
    if which == "documents":
        for s in wanted:
            assert abs(got[s] - wanted[s]) <= 40, (s, got[s], wanted[s])
    assert sorted(map(tuple, mixing.shares(docs, TableStore(spark)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_mixed_texts_hold_what_is_taken(spark, documents):
    taken = {r.doc_id: r.taken for r in mixing.shares(documents, TableStore(spark)).collect()}
    out = mixing.mix(documents, TableStore(spark))
    assert out.columns == documents.columns
    got, texts = Counter(), {r.doc_id: r.text for r in documents.collect()}
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
        assert r.text.split("\n")[0] in texts[r.doc_id]
    assert {d: n for d, n in taken.items() if n} == dict(got)


def test_apportion_is_sainte_lague(spark):
    rng = np.random.default_rng(1)
    for seats in (0, 1, 7, 40, 1000):
        votes = {i: float(v) for i, v in enumerate(rng.integers(0, 1000, 23))}
        df = spark.createDataFrame([(i, v, 10**6, seats) for i, v in votes.items()], "i long, votes double, cap long, seats long")
        got = {r.i: r.quota for r in mixing.apportion(df, [], "votes", "cap", "seats").collect()}
        quotients = sorted(((-v / (2 * q + 1), i) for i, v in votes.items() if v for q in range(seats)))[:seats]
        assert sorted(-v / (2 * q + 1) for i, v in votes.items() for q in range(got[i])) == sorted(q for q, _ in quotients)


@pytest.mark.parametrize("which", ["documents", "edges"])
def test_packing(spark, request, which):
    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(vocabulary())
    pieces = packing.pack(docs, vocabulary(), with_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])] += 1
    sequences, stream = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.asarray(p.ids, "<u4").tobytes()) and len(p.ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        stream[p.doc_id, p.doc_tokens].append((p.start, tuple(p.ids)))
    got = Counter()
    for (doc, n), parts in stream.items():
        for start, group in itertools.groupby(sorted(parts), key=lambda x: x[0]):
            for _, ids in group:
                got[doc, start, n] += len(ids)
    for (doc, ids), k in want.items():
        parts = sorted(stream[doc, len(ids)])
        if k == 1 and doc is not None:
            assert sum((p for _, p in parts), ()) == ids
    assert sum(len(i) * k for (_, i), k in want.items()) == sum(p.length for p in pieces)
    waste = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        waste += 0 if at & (at - 1) == 0 else 4096 - at
    assert waste == 0


def test_windows_cover_items_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 700):
        sizes = rng.integers(1, 4097, n).tolist()
        spans = defaultdict(list)
        for window in packing.pack_lengths(sizes):
            assert sum(w[2] for w in window) <= 4096
            for item, start, length in window:
                spans[item].append((start, length))
        for i, size in enumerate(sizes):
            at = 0
            for start, length in sorted(spans[i]):
                assert start == at and length > 0
                at += length
            assert at == size


def test_closest_fill_is_best():
    rng = np.random.default_rng(4)
    for _ in range(50):
        counts = Counter(rng.integers(1, 40, 6).tolist())
        target = int(rng.integers(1, 120))
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        taken = packing.closest_fill(sorted(counts), counts, target)
        assert all(n <= counts[length] for length, n in taken.items())
        assert sum(length * n for length, n in taken.items()) == max(s for s in sums if s <= target)


def test_materialise_round_trip(spark, documents):
    store = TableStore(spark)
    path = materialise.write_shards(documents, store, vocabulary(), length=256, shard_rows=64)
    rows = materialise.read_shards(spark, path, 256, 64).collect()
    made = store.read("sequences").collect()
    assert sorted(r.slot for r in rows) == list(range(len(made)))
    assert Counter(bytes(r.ids) for r in rows) == Counter(bytes(r.ids) for r in made)
    assert all(r.byte_offset == r.slot % 64 * 513 and r.shard == r.slot // 64 for r in rows)
    tokenizer = Tokenizer.from_file(vocabulary())
    total = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in documents.collect())
    assert sum(r.n_tokens for r in made) == total
    later = materialise.read_shards(spark, path, 256, 64, from_slot=100).collect()
    assert sorted((r.slot, bytes(r.ids)) for r in later) == sorted((r.slot, bytes(r.ids)) for r in rows if r.slot >= 100)


def test_slots_are_a_permutation():
    for total in (1, 2, 3, 17, 1000, 4097):
        for key in (0, 5):
            assert sorted(materialise.slots(np.arange(total), total, key).tolist()) == list(range(total))
    assert materialise.slots(np.arange(1000), 1000, 1).tolist() != materialise.slots(np.arange(1000), 1000, 2).tolist()


def shingles(text):
    w = words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_hand(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            i, j = sorted((find(a), find(b)))
            parent[j] = i
    return {d: find(d) for d in parent}


@pytest.mark.parametrize("which", ["documents", "edges", "crowd"])
def test_near_duplicates(spark, request, which, monkeypatch):
    if which == "crowd":
        # One large bucket, some members of which are not linked with its smallest one.
        monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
        rng = np.random.default_rng(2)
        base = [f"w{i}" for i in range(60)]
        rows = []
        for i in range(60):
            own = list(base)
            for k in rng.choice(60, 1 + i % 5, replace=False):
                own[k] = f"x{i}-{k}"
            rows.append((1000 - i, " ".join(own)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = request.getfixturevalue(which)
    got = near_dedup.near_duplicates(docs, TableStore(spark)).collect()
    source = [(r.doc_id, r.text) for r in docs.collect()]
    want = components_by_hand(source)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(shingles(t))) for d, t in source)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    if which == "edges":
        kept = near_dedup.keep_one(docs, TableStore(spark))
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_line_dedup(spark, documents):
    out = {r.doc_id: r for r in line_dedup.drop_recurring(documents, TableStore(spark)).collect()}
    first = {}
    for r in documents.orderBy("doc_id").collect():
        kept = []
        for line in r.text.split("\n"):
            bare = line.strip(" \t\n\x0b\x0c\r")
            if bare and first.setdefault(bare, r.doc_id) < r.doc_id:
                continue
            kept.append(line)
        mine = out[r.doc_id].text.split("\n") if out[r.doc_id].n_dropped < out[r.doc_id].n_lines else []
        assert not set(mine) - set(kept)  # every exact repeat went
        assert out[r.doc_id].n_chars == len(out[r.doc_id].text)


def test_line_templates_generalise(spark):
    line = "Posted by {} on {} in the daily news section of this site with {} replies and more"
    rows = [(i, "Body of number " + "abcdefgh"[i] * 3 + " stays here\n" + line.format("ABCDEFGH"[i] * 4, f"2020-01-0{i + 1}", i)) for i in range(8)] + [(20, None), (21, ""), (None, "x\n\ny"), (22, "1 2 3"), (23, "4 5 6")]
    out = {r.doc_id: r for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), TableStore(spark)).collect()}
    assert "\n" in out[0].text and all("\n" not in out[i].text and out[i].text.startswith("Body") for i in range(1, 8))
    assert out[20].text is None and out[21].text == "" and out[None].text == "x\n\ny" and out[22].text == "1 2 3" and out[23].text == "4 5 6"


def base_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, documents):
    odd = ["Under the MIT License! under-the-mit-license", "cc by nc cc by nc x CC-BY-NC", "Licensed under the GNU General Public License, version 3 or any later version.", "cc", "gplv3 and Apache License, Version 2.0 under the MIT license z", None, "", "mit license " * 3000, "license only", "CC0 here, (CC BY-SA 4.0)"]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(extra)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == base_by_hand(r.text), r.doc_id
        assert 0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and g.labels == ",".join(sorted(set(g.labels.split(","))))
    assert got[10_002].labels == "gpl-3-or-later" and got[10_009].labels == "cc-by-sa-4.0,cc0-1.0" and got[10_008].labels == "" and got[10_005].score == 0
    assert len(licenses.rules()) > 300


def sample_of(pattern):
    """A shortest text the pattern matches."""
    def one(parts):
        out = ""
        for op, arg in parts:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += chr(arg[0][1])
            elif name == "BRANCH":
                out += one(arg[1][0])
            elif name == "SUBPATTERN":
                out += one(arg[3])
            elif name == "MAX_REPEAT":
                out += one(arg[2]) * arg[0]
            else:
                assert name == "ASSERT", name
        return out
    return one(re._parser.parse(pattern)).strip()


def test_each_license_rule_finds_its_sample_also_wrapped(spark):
    rules = licenses.rules()
    samples = [sample_of(pattern) for _, pattern, *_ in rules]
    assert all(f" {keyword}" in f" {x}" for (keyword, *_), x in zip(rules, samples, strict=True))
    ways = [lambda x: f"Some {x} here", lambda x: "/* see\n * " + x.replace(" ", "\n * ") + "\n */", lambda x: x.replace(" ", "-"), lambda x: x.upper().replace(" ", "  ")]
    rows = [(len(ways) * i + k, way(x)) for i, x in enumerate(samples) for k, way in enumerate(ways)]
    out = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [(rows[i][1], rules[i // len(ways)][2], got) for i, got in out.items() if rules[i // len(ways)][2] not in got]
    assert not missed, missed[:10]


def statistics_by_hand(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, documents, edges):
    docs = documents.unionByName(edges.select(*documents.columns))
    got = quality.judge(docs, TableStore(spark)).collect()
    want = Counter()
    for r in docs.collect():
        s = statistics_by_hand(r.text)
        want[(r.doc_id, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_rejects_outliers_and_keeps_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.judge(docs, TableStore(spark)).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in out.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_small_groups_are_judged_by_pooled_estimates(spark):
    rng = np.random.default_rng(9)
    fresh = lambda n, end="": " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) + end for _ in range(n))
    groups = [("en", f"s{k}", 10) for k in range(6)] + [("de", "s0", 3), (None, "s1", 2), ("fr", None, 1)]
    rows = [(100 * g + i, fresh(int(rng.integers(150, 400))), la, s) for g, (la, s, n) in enumerate(groups) for i in range(n)]
    bad = {100 * g + 90: (la, s) for g, (la, s, _) in enumerate(groups)}
    rows += [(i, fresh(200, "#$%&*|<>#$%"), la, s) for i, (la, s) in bad.items()]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), TableStore(spark)).collect()}
    assert len(out) == len(rows) and all(r.d2 is not None and not r.base_failed for r in out.values())
    assert all(r.kept == (i not in bad) for i, r in out.items())


def test_substrings(spark, edges):
    rng = np.random.default_rng(6)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n))
    passage = fresh(60)
    rows = [(i, f"{fresh(100 + i)} {passage} {fresh(90)}") for i in range(20)] + [(100 + i, fresh(200)) for i in range(20)] + [(200, None), (201, "")]
    out = {r.doc_id: r for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), TableStore(spark)).collect()}
    texts = dict(rows)
    assert out[0].kept and out[0].text == texts[0] and out[200].text is None and out[201].text == ""
    assert all(not out[i].kept and len(out[i].text) < len(texts[i]) - 140 for i in range(1, 20))
    assert all(out[i].kept and out[i].text == texts[i] for i in range(100, 120))
    again = substring_dedup.drop_repeats(edges, TableStore(spark)).collect()
    assert len(again) == edges.count()


def test_passages_of_51_words_always_go(spark):
    rows, want = [], {}
    for seed in range(200):
        rng = np.random.default_rng(1000 + seed)
        fresh = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n))  # noqa: E731, B023
        passage, head, tail = fresh(51), fresh(int(rng.integers(0, 80))), fresh(int(rng.integers(1, 80)))
        rows += [(10 * seed, f"{fresh(30)} {passage} {fresh(20)}"), (10 * seed + 1, f"{head} {passage} {tail}".strip())]
        want[10 * seed + 1] = f"{head} {tail}".strip()
        twice, end = fresh(51), fresh(9)
        rows.append((10 * seed + 2, f"{twice} {fresh(5)} {twice} {end}"))
        want[10 * seed + 2] = rows[-1][1][: -len(f"{twice} {end}")] + end
    out = {r.doc_id: r for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), TableStore(spark)).collect()}
    texts = dict(rows)
    assert all(out[i].text == want.get(i, texts[i]) for i in texts)


def test_chunks_resist_shifts():
    rng = np.random.default_rng(7)
    text = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(2000)).encode()
    cut = lambda b: set(np.split(np.frombuffer(b, np.uint8), substring_dedup.chunks(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0])[k].tobytes() for k in range(100))
    assert len(cut(text) & cut(b"inserted words here " + text)) >= 90


def test_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    extra = spark.createDataFrame([(10**6 + i, [1.0] * 64) for i in range(30)] + [(10**7, None), (2 * 10**7, [0.0] * 64), (3 * 10**7, [float("nan")] * 64), (4 * 10**7, [1.0, None] * 32), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    df = df.union(extra)
    got = defaultdict(list)
    for r in neighbours.search(df, TableStore(spark), F.col("vec_id") % 100 == 0, shard_rows=1500).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    rows = [(r.vec_id, np.asarray(r.embedding, float)) for r in df.filter("vec_id is not null and embedding is not null").collect() if None not in r.embedding]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, vectors = np.asarray([i for i, _ in rows]), np.stack([v for _, v in rows])
    hits = total = 0
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
            want = [k for k in np.lexsort((ids, d)) if ids[k] != i][:10]
            hits += len({int(ids[k]) for k in want} & {x for _, x in got[i]})
            total += 10
            assert got[i] == sorted(got[i])
            where = {int(k): x for k, x in zip(ids, d, strict=True)}
            assert all(abs(s - where[x]) < 1e-9 for s, x in got[i]) and len(got[i]) == 10
    assert hits / total >= 0.95
    assert [x for _, x in got[10**6]] == [10**6 + i for i in range(1, 11)]


def test_pages(spark):
    page = ('<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
            '<div class="ad">Buy &lt;now&gt;</div><article><h1>Head</h1><p><b>One  &amp;\n two<br><p>Three <i>four</i>.</p><section class="comments"><p>I say</p></section></article>'
            '<aside>Side</aside><form><p>F</p></form><footer>&copy; x</footer></body></html>')
    plain = "<html><body><div class=x><p>Site name</p></div><div><p>Story {0} one {0}</p><p>Story {0} two and more words {0}</p></div><div><p>All rights</p></div></body></html>"
    rows = [(1, "http://a.x/1", page), (2, None, None), (3, "http://a.x/3", ""), (4, "x", "text only &am"), (5, "http://a.x/5", page[:330]), (1, "http://a.x/1", page)]
    rows += [(100 + i, f"http://b.x/{i}", plain.format(f"n{i}" * 3)) for i in range(6)]
    got = defaultdict(list)
    for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), TableStore(spark)).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == ["Head\nOne & two\nThree four."] * 2
    assert got[2] == [""] and got[3] == [""] and got[4] == ["text only &am"]
    assert got[5][0].startswith("Head\nOne & two")
    assert all(got[100 + i] == [f"Story {'n%d' % i * 3} one {'n%d' % i * 3}\nStory {'n%d' % i * 3} two and more words {'n%d' % i * 3}"] for i in range(6))


def test_slot_and_template_decide_where_pages_have_articles(spark):
    page = ('<html><body><article><h1>Head {0}</h1><div class="q"><p>Our shop has offers</p></div><div class="t"><p>Story {0} goes {0} and on with many words {0}</p></div></article>'
            '<div class="z"><article><p>Card one {0}</p></article><article><p>Card two</p></article></div></body></html>')
    rows = [(i, f"http://c.x/{i}", page.format(f"n{i}" * 3)) for i in range(6)]
    rows.append((6, "http://c.x/6", page.format("n6n6n6").replace("Our shop has offers", "A note of its own")))
    rows.append((10, "http://one.x/1", page.format("alone")))
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), TableStore(spark)).collect()}
    story = lambda n: f"Story {n} goes {n} and on with many words {n}"
    assert all(out[i] == f"Head {'n%d' % i * 3}\n{story('n%d' % i * 3)}" for i in range(6))
    assert out[6] == f"Head n6n6n6\nA note of its own\n{story('n6n6n6')}"
    assert out[10].startswith("Head alone\nOur shop has offers\nStory alone")  # one page tells nothing of its host


def test_copies_and_odd_pages_do_not_decide_for_a_host(spark):
    plain = "<html><body><div class=x><p>Site name</p></div><div><p>Story {0} one {0}</p><p>Story {0} two and more words {0}</p></div><div><p>All rights</p></div></body></html>"
    other = "<html><body><section><div><div><p>Table of {0}</p><p>More of {0} with some words {0}</p></div></div></section><section><p>Other site line</p></section></body></html>"
    names = [f"n{i}" * 3 for i in range(6)]
    rows = [(100 + i, f"http://d.x/{i}", plain.format(n)) for i, n in enumerate(names)]
    rows += [(200 + i, f"http://d.x/copy{i}", plain.format("copied")) for i in range(20)]
    rows += [(300 + i, f"http://d.x/t{i}", other.format(n)) for i, n in enumerate(names[:5])]
    rows += [(400 + i, f"http://d.x/empty{i}", (None, "", "<p>", "<table><tr><td>odd</table>")[i % 4]) for i in range(40)]
    rows += [(500 + i, f"http://e.x/{i}", plain.format("copied")) for i in range(5)]
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), TableStore(spark)).collect()}
    story = lambda n: f"Story {n} one {n}\nStory {n} two and more words {n}"
    assert all(out[100 + i] == story(n) for i, n in enumerate(names))
    assert all(out[200 + i] == story("copied") for i in range(20))
    assert all(out[300 + i] == f"Table of {n}\nMore of {n} with some words {n}" for i, n in enumerate(names[:5]))
    assert out[400] == out[401] == "" and all(story("copied") in out[500 + i] for i in range(5))


def test_given_pages_give_their_article(spark):
    for r in pages.extract(spark.read.parquet(f"{SF}/pages.parquet"), TableStore(spark)).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", re.sub("<[^>]*>", "", x)).strip() for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert r.text == "\n".join(x for x in (x.replace("&amp;", "&").replace("&quot;", '"').replace("&lt;", "<").replace("&gt;", ">") for x in parts) if x)


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    store = TableStore(spark)
    assert mixing.shares(none, TableStore(spark)).count() == mixing.mix(none, TableStore(spark)).count() == 0
    assert packing.pack(none, vocabulary()).count() == 0
    assert near_dedup.near_duplicates(none, TableStore(spark)).count() == 0
    assert line_dedup.drop_recurring(none, TableStore(spark)).count() == 0
    assert licenses.scan(none).count() == quality.judge(none, TableStore(spark)).count() == 0
    assert substring_dedup.drop_repeats(none, TableStore(spark)).count() == 0
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string"), TableStore(spark)).count() == 0
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), TableStore(spark), F.col("vec_id") % 100 == 0).count() == 0
    assert materialise.read_shards(spark, materialise.write_shards(none, store, vocabulary())).count() == 0


def test_pipeline_stages_on_edge_rows(spark, edges):
    import corpus_pipeline

    docs = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = TableStore(spark).write(stage(spark, docs, SF), name)
        assert docs.columns == edges.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(77)
    fresh = lambda n: ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(n)]
    shared = [fresh(int(rng.integers(45, 120))) for _ in range(12)]
    texts = {}
    for i in range(150):
        parts = [fresh(int(rng.integers(5, 60)))]
        for k in rng.choice(12, int(rng.integers(0, 3)), replace=False):
            parts += [shared[k], fresh(int(rng.integers(5, 60)))]
        texts[i] = [w for p in parts for w in p]
    # Plain rule: every word that lies in 45 words found in a document before goes, others stay.
    seen, want = set(), {}
    for i, ws in texts.items():
        gone, own = set(), [tuple(ws[k : k + 45]) for k in range(len(ws) - 44)]
        for k, x in enumerate(own):
            if x in seen:
                gone.update(range(k, k + 45))
        seen.update(own)
        want[i] = [w for k, w in enumerate(ws) if k not in gone]
    rows = spark.createDataFrame([(i, " ".join(ws), "x", 0) for i, ws in texts.items()], "doc_id long, text string, row_key string, doc int")
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(rows, TableStore(spark)).collect()}
    assert {i: r.text.split() for i, r in got.items()} == want
    assert all(r.kept == (len(want[i]) == len(texts[i])) for i, r in got.items())
