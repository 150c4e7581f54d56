"""Swap packing, importance resampling and conversation repair against brute force and on edge rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skysift.llm import bin_swaps, byte_tokens, importance, oracles, pages, repair
from skysift.llm.arrays import blocks
from skysift.llm.queries import byte_vocabulary
from skysift.session import TableStore

SF = "/root/testdata/sf0.001"
CLASHING = "row_key string, _segment int, score int, length int, place int"


@pytest.fixture(scope="module")
def edges(spark):
    base = " ".join(f"Word{i}x" for i in range(80))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (6, base), (7, base), (7, base), (8, base + " tail"), (None, base), (None, None),
        (9, "é x\xa0y ß日本 😀\x1cz"), (10, ("long " * 3 + "x\n") * 9000), (12, "<|endoftext|> it's 12%  don't\r\n\n we'll"), (13, "x" * 70000), (14, "ä" * 5000),
    ]
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4) for i, t in rows], f"doc_id long, text string, {CLASHING}")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# --- packing


def test_byte_ids_equal_the_tokenizer(documents):
    coder, rng = byte_tokens.ByteIds(byte_vocabulary()), random.Random(1)
    alphabet = [*"abst mdrevl'' \n\t  .,!0129ÄéßÖ÷×ñ–’€«»²ª_ɐ", "'s", "'re", " '", "\r\n", "日"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["", "  ", "a ", "x<|endoftext|> y's", "\xa0x", "don't we'll 'tis ''s x''s 's", *(r.text for r in documents.collect())]
    want = [[*e.ids, 2] for e in coder.full.encode_batch(texts, add_special_tokens=False)]
    got = []
    for _, _, buf, offs in blocks(pa.array(texts)):
        ids, at = coder.encode(buf, offs, 2)
        got += [ids[a:b].tolist() for a, b in itertools.pairwise(at.tolist())]
    assert got == want


@pytest.mark.parametrize("block_tokens", [1 << 22, 3000])
@pytest.mark.parametrize("which", ["documents", "edges"])
def test_swap_packing(spark, request, which, block_tokens):
    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(byte_vocabulary())
    pieces = bin_swaps.pack(docs.repartition(3), byte_vocabulary(), TableStore(spark), block_tokens=block_tokens).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.asarray([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        head = (len(ids) - 1) % 1024 + 1
        for k, start in enumerate([0, *range(head, len(ids), 1024)]):
            part = ids[start : start + (1024 if k else head)]
            want[r.doc_id, k, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = bin_swaps.lower_bound(np.asarray([p.length for p in pieces]), 1024)
    assert least <= len(sequences) <= least + (0.02 if block_tokens > 3000 else 0.03) * least + 1


def smallest_number_of_bins(lengths, capacity):
    """By trying every bin for every piece."""
    best = [len(lengths)]

    def go(k, fills):
        if len(fills) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(fills)
            return
        for b, fill in enumerate(fills):
            if fill + lengths[k] <= capacity and fill not in fills[:b]:
                go(k + 1, [*fills[:b], fill + lengths[k], *fills[b + 1 :]])
        go(k + 1, [*fills, lengths[k]])

    go(0, [])
    return best[0]


def test_search_is_near_the_optimum_and_never_below_the_bound():
    rng, extra = random.Random(3), 0
    for _ in range(150):
        lengths = [rng.randint(1, rng.choice([20, 10])) for _ in range(9)]
        least = smallest_number_of_bins(sorted(lengths, reverse=True), 20)
        got = bin_swaps.packed(lengths, 20)
        assert sorted(i for b in got for i in b) == list(range(9)) and all(sum(lengths[i] for i in b) <= 20 for b in got)
        assert bin_swaps.lower_bound(np.asarray(lengths), 20) <= least <= len(got)
        extra += len(got) - least
    assert extra <= 3


def test_steps_raise_squared_fill_and_empty_sequences():
    rng = np.random.default_rng(0)
    lengths = rng.integers(250, 400, 3000).tolist()
    bins = bin_swaps.Bins(lengths, 1024)
    bins.best_fit()
    before, squares = len(bins.items), sum(f * f for f in bins.fill)
    bins.search(bin_swaps.lower_bound(np.asarray(lengths), 1024))
    assert sum(f * f for f in bins.fill) > squares
    assert sum(map(bool, bins.items)) < before - 20
    assert all(sum(lengths[i] for i in x) == f for x, f in zip(bins.items, bins.fill, strict=True))


# --- importance


def features(text, n=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def resampled_by_hand(docs, target, n, buckets, percent, min_words):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, n)[0])

    s, t = counts(d[1] for d in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    rows = []
    for doc_id, text in docs:
        found, n_words = features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= min_words))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = percent * len(order) // 100
    return Counter([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in rows if not r[4]])


@pytest.mark.parametrize("n,segments,percent", [(1, 1, 10), (1, 7, 60), (3, 50, 100), (2, 3, 0)])
@pytest.mark.parametrize("which", ["documents", "edges"])
def test_resampling(spark, request, which, n, segments, percent):
    docs = request.getfixturevalue(which)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = importance.resample(docs.repartition(5), target, TableStore(spark), max_words=n, buckets=500, percent=percent, segments=segments, min_words=3)
    want = resampled_by_hand([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], n, 500, percent, 3)
    assert Counter(map(tuple, out.select("doc_id", "n_features", "weight", "score", "rank").collect())) == want


def test_ranks_by_regular_sampling_of_many_runs(spark, monkeypatch):
    """More runs than are merged at once, crowded scores and repeated rows."""
    monkeypatch.setattr(importance, "MERGED_RUNS", 3)
    rows = spark.range(0, 20000, 1, 13).select((F.col("id") % 9000).alias("doc_id"), F.lit(1).alias("n_features"), F.lit(2).alias("weight"),
                                               F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 1000).cast("long").alias("score"))
    store = TableStore(spark)
    out = importance.ranked(store.write(rows, "in"), 12345, 16, store).select("score", "doc_id", "rank").collect()
    order = sorted(((-r.score, r.doc_id) for r in rows.collect()))
    got = sorted((r.rank, -r.score, r.doc_id) for r in out if r.rank is not None)
    assert got == [(k + 1, *order[k]) for k in range(12345)] and len(out) == 20000
    cuts = importance.splitters(store.write(rows, "again"), 16, store)
    placed = importance.with_segment(rows, cuts).groupBy("_segment").count().collect()
    assert len(placed) >= 15 and max(r["count"] for r in placed) < 2 * 20000 / 16


# --- conversations


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def repaired_by_hand(rows):
    """Counts, cost, audit and lines of one conversation by a shortest path over (row, state)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("ok" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}
    full = {"u": "user", "a": "assistant"}

    def offer(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(4):
            for state, (c, a, lines) in list(table.items()):
                for r in "ua":
                    if (state, r) in step:
                        offer(table, step[state, r], (c + 3, a + "I", (*lines, f"{full[r]}:")))
        return table

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (c, a, lines) in inserted(best).items():
            offer(after, state, (c + 4, a + "D", lines))
            if fault in ("ok", "truncated"):
                late = 3 * (fault == "truncated")
                if (state, role[:1]) in step:
                    offer(after, step[state, role[:1]], (c + late, a + "K", (*lines, f"{role}:{text}")))
                for r in "ua":
                    if (state, r) in step:
                        offer(after, step[state, r], (c + 3 + late, a + "R", (*lines, f"{full[r]}:{text}")))
        best = after
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def reports_by_hand(rows):
    by_conv = defaultdict(list)
    for r in damaged_by_hand(rows):
        by_conv[r[0]].append(r)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: repaired_by_hand(by_conv[c]) if c in by_conv else nothing for c in {r[0] for r in rows}}


def odd_conversations():
    rng = random.Random(5)
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (None, None, None, None), (1, None, "user", "x"), (2, 5, "assistant", "a."), (2, 5, "assistant", "a.")]
    for conv in range(3, 60):
        for _ in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]),
                         rng.choice(["A.", "B!", "C", " ", "", None, "D? \n", "e.\x1c"])))
    # One conversation far longer than the rest, with repeats.
    rows += [(100, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Text {t}", f"Text {t}."])) for t in range(1500)]
    return rows


@pytest.mark.parametrize("which", ["given", "odd"])
def test_repair(spark, which):
    schema = f"conv_id long, turn long, role string, text string, {CLASHING}"
    if which == "given":
        df = spark.read.parquet(f"{SF}/conversations.parquet")
    else:
        df = spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in odd_conversations()], schema).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(df, repair.damaged(df), TableStore(spark)).collect()}
    assert got == reports_by_hand([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_a_conversation_is_spread_over_tasks(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"Text {t}." if t % 5 else "again.") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    store = TableStore(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered, summaries = repair.segments(df, store)
        results = repair.parsed(summaries, store)
        lines = repair.repaired(ordered, results)
        assert summaries.count() > 1
        got, want = results.first(), repaired_by_hand(rows)
        assert (got.gaps, got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit) == want[:7]
        assert repair.digests(lines).first().repaired_sha256 == want[7]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_halved_spans_equal_the_chart_over_all_splits():
    """The chart fills every span from every split; spans halved give the same cells."""
    rng = random.Random(9)
    for _ in range(60):
        kinds = "".join(rng.choice("suaSUAoOx") for _ in range(rng.randint(1, 9)))
        n = len(kinds)
        chart = {(i, i + 1): repair.row_cell(kinds[i]) for i in range(n)}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                chart[i, i + size] = repair._least([x for k in range(i + 1, i + size) for x in repair.joined(chart[i, k], chart[k, i + size])])
        assert repair.span_cell(kinds) == chart[0, n]


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert bin_swaps.pack(none, byte_vocabulary(), TableStore(spark)).count() == 0
    assert importance.resample(none, none, TableStore(spark)).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(talks, repair.damaged(talks), TableStore(spark)).count() == 0
    some = importance.resample(documents, none, TableStore(spark))
    assert some.count() == documents.count()


def test_sql_crc_equals_zlib():
    import duckdb

    for text in ("", "7:12", "é-ß日本", "x" * 300):
        sql = f"WITH {oracles.CRC_TABLE} SELECT {oracles.crc32('w')} FROM (SELECT $1::VARCHAR AS w), crc_table"
        assert duckdb.execute(sql, [text]).fetchall() == [(zlib.crc32(text.encode()),)]


# --- pages


@pytest.mark.parametrize("name", ["layout with-sidebar", "has-sidebar", "content no-comments", "post ad-free", "social-science", "related-work", "entry notice"])
def test_a_class_name_never_empties_a_page(name):
    page = f'<body><div class="menu">Menu</div><div class="{name}"><article><p>The text.</p></article></div><div class="sidebar">Side</div></body>'
    assert pages.main_text(pages.parse(page), None) == "The text."
    cards = '<body><main><p>The text.</p></main><div class="related"><article><p>Another.</p></article></div></body>'
    assert pages.main_text(pages.parse(cards), None) == "The text."


def test_own_leads_stay_where_others_share_theirs(spark):
    def page(lead, k):
        return f"<html><body><div><p>{lead}</p></div><div><h1>Title {k}</h1><div><p>{f'Own words {k} ' * 20}</p></div></div></body></html>"

    rows = [(k, f"http://h.org/{k}", page("A shared lead." if k < 3 else f"A lead of its own, {k}.", k)) for k in range(6)]
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), TableStore(spark)).collect()}
    assert all(f"A lead of its own, {k}." in out[k] for k in range(3, 6)) or all(f"Own words {k}" in out[k] for k in range(6))


def test_deep_and_wide_pages():
    deep = "<div>" * 100_000 + "<p>At the bottom.</p>"
    assert pages.main_text(pages.parse(deep), None) == "At the bottom."
    row = "<tr><td>a</td><td><div>b</div></td></tr>"
    shapes = [pages.skeleton(pages.parse(f"<table>{row * n}<tr><th>x</th></tr></table>"))[0] for n in (20_000, 15_000)]
    assert len(pages.matched(*shapes)) == min(map(len, shapes))


def test_matching_is_as_large_as_by_hand():
    def by_hand(a, b):
        kids = [defaultdict(list) for _ in range(2)]
        for k, shape in enumerate((a, b)):
            for i, (_, above) in enumerate(shape):
                kids[k][above].append(i)

        def size(i, j):
            if i >= 0 and a[i][0] != b[j][0]:
                return 0
            xs, ys = kids[0][i], kids[1][j]
            table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            for r, x in enumerate(xs, 1):
                for c, y in enumerate(ys, 1):
                    table[r][c] = max(table[r - 1][c], table[r][c - 1], table[r - 1][c - 1] + size(x, y))
            return table[-1][-1] + 1

        return size(-1, -1) - 1

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([[rng.choice("pqr"), rng.randint(-1, i - 1)] for i in range(rng.randint(1, 9))] for _ in range(2))
        got = pages.matched(a, b)
        assert len(got) == by_hand(a, b) and all(a[x][0] == b[y][0] for x, y in got.items())
        assert all((a[x][1] == -1 and b[y][1] == -1) or got.get(a[x][1]) == b[y][1] for x, y in got.items())
