"""Near duplicates, decontamination, packing, language and toxicity against plain versions."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from diffusio.llm import decontaminate, langid, neardup, packing, tokens, toxicity
from diffusio.llm.queries import tokenizer_path
from tests.llm.plain import components, contamination, shingles

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(4000)]


def words(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def corpus():
    """Texts with exact copies, near copies of all degrees, chains, shared passages, and odd ones."""
    rng = random.Random(11)
    out = [None, "", " ", "a b", "A  b", "a b c d e", "a b c d e f", "x\ty\nz"]
    for size in (6, 30, 90, 200):
        base = words(size, rng)
        for k in range(45):
            t = list(base)
            for _ in range(k % 9):
                t[rng.randrange(size)] = rng.choice(VOCABULARY)
            out.append(" ".join(t))
    chain = words(120, rng)
    for k in range(0, 60, 3):
        out.append(" ".join(chain[k:] + words(k, rng)))
    passage = words(40, rng)
    out += [" ".join(words(60, rng) + passage + words(60, rng)) for _ in range(60)]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("fits", [neardup.CELL_ROWS, 12, 3])
def test_near_duplicates(spark, monkeypatch, fits):
    monkeypatch.setattr(neardup, "CELL_ROWS", fits)  # few: regions are divided by pivots in Spark, and cut into parts
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, x int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == components(rows)


def test_near_duplicates_edge(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (5, "q r s")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()))
    assert got == [(0, 2, 2), (2, 2, 2), (5, 1, 5), (5, 2, 2), (5, 2, 2)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert [r["component_id"] for r in neardup.near_duplicates(df.limit(1)).collect()] == [5]


def test_winnow_guarantee():
    rng = np.random.RandomState(2)
    for n in (3, 9, 10, 40):
        h = rng.randint(0, 5, n).astype(np.uint64)
        kept = set(decontaminate.winnow(h, np.array([0, n])).tolist())
        for lo in range(max(1, n - 8)):
            window = range(lo, min(n, lo + 9))
            least = min(h[i] for i in window)
            assert {i for i in window if h[i] == least} & kept


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 60])
def test_contamination(spark, block):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng.choice([1, 4, 12, 13, 14, 40, 100]), rng))) for i in range(30)] + [(30, None), (31, "- - -"), (3, "extra item of equal id")]
    items.append((32, items[5][1]))
    docs = [(0, None), (1, ""), (2, "...")]
    for k in range(60):
        said = (items[rng.randrange(30)][1]).split()
        cut = said[rng.randrange(3) :][: rng.choice([12, 13, 30])]
        docs.append((3 + k, " ".join(words(rng.randrange(60), rng)) + " " + ", ".join(cut).upper() + " " + " ".join(words(rng.randrange(60), rng))))
    docs.append((99, " ".join(words(300_000, rng)) + " " + items[0][1] + " " + items[7][1]))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs + docs[-1:]], "doc_id long, text string, r int, _row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(df, bench, block_words=block).collect()
    assert len(got) == len(docs) + 1
    for r in got:
        c = r["contamination"]
        assert r["_row"] == 2 and (c["n_words"], c["n_hit"], c["items"], c["contaminated"]) == contamination(dict(docs)[r["doc_id"]], items)
    assert decontaminate.find_contamination(df, bench.limit(0)).where("contamination.n_hit > 0").count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


def check_plan(counts, capacity, patterns):
    used = {}
    for p, n in patterns:
        total = 0
        while p:
            p, length, each = p
            used[length] = used.get(length, 0) + each * n
            total += length * each
        assert 0 < total <= capacity and n > 0
    assert used == counts
    return sum(n for _, n in patterns)


def plain_bfd(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(b, i) for i, b in enumerate(bins) if b >= length]
            if fits:
                bins[min(fits)[1]] -= length
            else:
                bins.append(capacity - length)
    return len(bins)


def exact_bins(items, capacity):
    """The least number of sequences, by search."""
    best = len(items)

    def go(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for i in sorted(set(bins)):
            if i >= items[at]:
                go(at + 1, sorted([*[b for k, b in enumerate(bins) if k != bins.index(i)], i - items[at]]))
        go(at + 1, sorted([*bins, capacity - items[at]]))

    go(0, [])
    return best


def test_packing_plans():
    rng = random.Random(4)
    for _ in range(300):
        capacity, counts = rng.choice([7, 10, 20]), {}
        for _ in range(rng.randrange(1, 8)):
            x = rng.randrange(1, capacity + 1)
            counts[x] = counts.get(x, 0) + 1
        fixed, rest = packing.reduce_dominated(counts, capacity)
        items = sorted((k for k, v in rest.items() for _ in range(v)), reverse=True)
        every = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
        # the reduction never costs a sequence
        assert sum(n for _, n in fixed) + exact_bins(items, capacity) == exact_bins(every, capacity)
        check_plan(counts, capacity, packing.plan(counts, capacity, "dominance"))
        assert check_plan(counts, capacity, packing.plan(counts, capacity, "decreasing")) == plain_bfd(counts, capacity)


ODD = ["", "  ", " a", "a ", "a\n\nb", "a\tb c", "a\n b", "it's <|endoftext|> I'll", "　x y", "x\x1cy", "é́ ñ\n\n", "😀 z", "x" * 300]


def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_ids():
    ids, enc = reference_ids(), tokens.encoder(tokenizer_path())
    for text in [*ODD, *[t or "" for _, t in corpus()[:60]]]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n \t" * 400_000 + "b<|endoftext|>", "é" + " " * 1_000_000 + "!", "a" * 10_000_000])
def test_token_ids_of_long_runs(text):
    assert np.array_equal(np.frombuffer(tokens.encoder(tokenizer_path()).encode(text), "<u4"), reference_ids()(text))


def test_token_ids_around_cut_runs(monkeypatch):
    monkeypatch.setattr(tokens, "LONG_BLANKS", 3)
    monkeypatch.setattr(tokens, "_RUN", re.compile(f"[{tokens.BLANK}]{{3,}}"))
    ids, enc, rng = reference_ids(), tokens.encoder(tokenizer_path()), random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice([" ", " ", "\n", "\t", "a", "'s", "1", "!", "\x85", "\xa0", "\x1c", "\u200b", "é", "<|endoftext|>"]) for _ in range(rng.randrange(25)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids(text)


def packed_rows(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None, *[" ".join(words(n)) for n in (5, 40, 300, 300, 300, 700)]])]
    rows += [rows[-1], (None, "x y"), (700, " " * 1_000_000 + "x")]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, _task int")


@pytest.mark.parametrize("small", [packing.BASES_BYTES, 0])
def test_pack_documents(spark, monkeypatch, small):
    monkeypatch.setattr(packing, "BASES_BYTES", small)  # 0: counts of tasks are joined by shuffling
    rows, df = packed_rows(spark)
    ids, capacity = reference_ids(), 64
    got = packing.pack_documents(df, tokenizer_path(), capacity).collect()
    whole = {i: [*ids(t), 0] for i, t in rows}
    seen = {}
    for r in got:
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= capacity and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == capacity
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r["length"] for r in got) == sum(len([*ids(t), 0]) for _, t in rows)
    assert packing.pack_documents(df.limit(0), tokenizer_path(), capacity).count() == 0


def test_pack_matrices(spark):
    rows, df = packed_rows(spark)
    ids, capacity = reference_ids(), 64
    got = packing.pack_matrices(df, tokenizer_path(), capacity).collect()
    said = {}
    for r in got:
        row = np.frombuffer(bytes(r["ids"]), f"<u{r['width']}")
        assert len(row) == capacity and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and r["cu_seqlens"][:-1] == r["positions_reset"]
        for doc, a, b in zip(r["doc_ids"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            said.setdefault(doc, []).append(row[a:b].tolist())
    for i, t in rows:
        whole, copies = [*ids(t), 0], sum(x == i for x, _ in rows)
        parts = [whole[a : a + n] for a, n in pieces_of(len(whole), capacity)]
        assert sorted(said[i]) == sorted(parts * copies)
    assert packing.pack_matrices(df.limit(0), tokenizer_path(), capacity).count() == 0


def test_matrices_are_written_and_read(spark, tmp_path):
    """What is read back holds every text's ids in order, by the cumulative lengths, and zeros behind them."""
    texts = [None, "", "one two three", "x y " * 300, "é" * 90]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    packing.write_matrices(packing.pack_matrices(df, tokenizer_path(), 64), str(tmp_path / "m"))
    back, ids = packing.read_matrices(spark, str(tmp_path / "m")), {i: 0 for i in range(len(texts))}
    for row in back.collect():
        n = packing.numbers(row)
        assert len(n) == 64 and not n[row["n_tokens"] :].any() and row["cu_seqlens"][-1] == row["n_tokens"] and row["positions_reset"] == row["cu_seqlens"][:-1]
        for doc, lo, hi in zip(row["doc_ids"], row["cu_seqlens"], row["cu_seqlens"][1:], strict=False):
            ids[doc] += int(n[lo:hi].astype(np.int64).sum())
    enc = tokens.encoder(tokenizer_path())
    assert ids == {i: int(np.frombuffer(enc.encode(t or ""), "<u4").astype(np.int64).sum()) for i, t in enumerate(texts)}
    assert sorted(map(str, back.collect())) == sorted(map(str, packing.pack_matrices(df, tokenizer_path(), 64).collect()))



def pieces_of(n, capacity):
    return [(a, len(p) // 4) for a, p in tokens.pieces(bytes(4 * n), capacity)]


def test_language(spark):
    rng = random.Random(8)
    tongues = {"aa": ["kala", "muna", "toki", "sina"], "bb": ["zwrx", "qvth", "jdfg", "pfff"], "cc": ["été", "çà", "où", "naïve"]}
    rows = [(i, " ".join(rng.choice(tongues[k]) for _ in range(20)), k) for i in range(240) for k in [rng.choice(list(tongues))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 3 <> 1"), sample=150)
    odd = spark.createDataFrame([(900, None, None), (901, "12 ?!", None), (902, "", None), (903, "kala " * 200_000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df.union(odd), model, "doc_id", "lang").collect()}
    held = [r for r in got.values() if r["doc_id"] % 3 == 1 and r["doc_id"] < 900]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    none = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, none, "doc_id").collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        t = words(rng.randrange(1, 60), rng)
        bad = rng.random() < 0.3
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["vile", "vileness", "scumbag"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "vile " * 50_000)], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(1, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, known.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i], t) for i, t in labels if i % 4 == 2]
    assert sum((s >= toxicity.THRESHOLD) == bool(t) for s, t in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[902] > 0.5 and got[900] == got[901]
    empty = toxicity.train(docs, known.limit(0))
    assert {r["toxicity"] for r in toxicity.score(docs, empty).collect()} == {0.0}


SHIPPED = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SHIPPED), reason="needs the shipped tables")
def test_near_duplicates_of_shipped_tables(spark, monkeypatch):
    docs = spark.read.parquet(f"{SHIPPED}/documents.parquet").select("doc_id", "text")
    seen = {}
    real = neardup.pooled_cells

    def watched(points):
        cells, places = real(points)
        by_text = cells.groupBy("x").agg(F.count("r").alias("k"))
        seen["regions"], seen["copied"] = cells.select("r").distinct().count(), by_text.where("k > 1").count()
        return cells, places

    monkeypatch.setattr(neardup, "pooled_cells", watched)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert seen["regions"] > 5 and seen["copied"] >= 0  # pools make regions; windows copy texts where pools share shingles


def test_tokens_are_shuffled_once_and_linked_texts_meet(spark, monkeypatch):
    """One exchange for the counts and bounds of all shingles; two linked texts share a region, in the lesser of their pools."""
    plans, kept, real, cells_of = [], {}, neardup.written, neardup.pooled_cells

    def watched(df, name, **options):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, **options)

    def pooled(points):
        kept["points"] = points
        kept["cells"], places = cells_of(points)
        return kept["cells"], places

    monkeypatch.setattr(neardup, "written", watched)
    monkeypatch.setattr(neardup, "pooled_cells", pooled)
    rows = [r for r in corpus() if shingles(r[1])]
    neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(p.count("Exchange hashpartitioning(") + p.count("BroadcastExchange") for name, p in plans if name == "shared") == 1
    regions = {}
    for r, i in kept["cells"].join(kept["points"], "x").select("r", "rep").collect():
        regions.setdefault(i, set()).add(r)
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), i)
    linked = [(a, b) for x, a in sets.items() for y, b in sets.items() if a < b and 100 * len(x & y) >= 80 * len(x | y)]
    assert linked and all(regions[a] & regions[b] for a, b in linked)


def test_windows_and_sets_are_written_once(spark, monkeypatch):
    """Windows are in one written table and cross one exchange, packed; no sets are written where all regions fit into a task."""
    tables, real = [], neardup.written

    def watched(df, name, **options):
        out = real(df, name, **options)
        tables.append((name, out.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(neardup, "written", watched)
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)
    assert [name for name, columns, _ in tables if "prefix" in columns] == ["shingles"]
    assert not [name for name, columns, _ in tables if "members" in columns]
    assert [name for name, _, plan in tables if "prefix" in plan.split("Relation")[0]] == ["shingles", "shared"]


@pytest.mark.parametrize(("packed", "held", "blocks"), [(50, 1 << 22, 8_192), (1 << 18, 3, 8_192), (400, 40, 0)])
def test_near_duplicates_of_packed_tokens(spark, monkeypatch, packed, held, blocks):
    for name, value in (("PACKED_TOKENS", packed), ("HELD_TOKENS", held), ("SENT_BLOCKS", blocks)):
        monkeypatch.setattr(neardup, name, value)  # few: packs of some texts, buckets that don't fit, firsts by a join
    rows = corpus()
    long = [t for _, t in rows if len((t or "").split()) > 40]
    twice = [*rows, *rows[::7], *[(i, long[k] + " more") for i, k in ((1_001, 0), (1_002, 50), (1_002, 50))]]  # repeated rows, too
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    want = components(list(dict.fromkeys(twice)))
    assert got == sorted((i, *want[i]) for i, _ in twice)


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=50), st.sampled_from([np.uint32, np.uint64]))
def test_planes(values, kind):
    v = np.array(values, dtype=np.uint64).astype(kind)
    assert (neardup._numbers(neardup._planes(v), kind) == v).all() and len(neardup._planes(v)) == v.nbytes


def test_bits_of_first_rows(spark):
    x = [0, 1, 2, 32_767, 32_768, 32_769, 65_536, 65_537, (3 << 33) - 1, 3 << 33, (3 << 33) + 1]
    rows = spark.createDataFrame([(v, k // 2, 0) for k, v in enumerate(x)], "x long, d1 long, d2 long")
    bits = neardup._First(rows).sent.value
    assert neardup._First.among(np.array(x), bits).tolist() == [k % 2 == 0 for k in range(len(x))]
    assert not neardup._First.among(np.array([3, 1 << 40]), bits).any()


def plain_links(sets):
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 80 * len(a | b)}


def same(edges, n, first=()):
    up = list(range(n))
    for a, b in [*first, *edges]:
        x, y = up[a], up[b]
        up = [y if v == x else v for v in up]
    return {(i, j) for i in range(n) for j in range(i) if up[i] == up[j]}


@given(st.lists(st.tuples(st.frozensets(st.integers(1, 30), min_size=1, max_size=24), st.booleans()), min_size=2, max_size=40))
@settings(max_examples=200, deadline=None)
def test_regions_find_what_is_linked(members):
    sets = [s for s, _ in members]
    settled = [i for i, (_, s) in enumerate(members) if s]
    known = [(settled[0], i) for i in settled[1:]]
    region = neardup._Region([np.array(sorted(s), dtype=np.uint64).tobytes() for s in sets], [s for _, s in members])
    region.join(np.arange(len(sets)))
    assert same(region.links, len(sets), known) == same(plain_links(sets), len(sets), known)
    assert set(map(lambda e: (max(e), min(e)), region.links)) <= plain_links(sets)


def test_long_texts_are_near_duplicates(spark):
    rng = random.Random(12)
    long = words(150_000, rng)
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-9], *words(9, rng)])), (3, " ".join(long[:75_000])), (4, "x" * 3_000_000), (5, "x " * 1_000_000), (6, "X\tx x x x")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
