"""Exact duplicates, the manifest and token alignment against plain versions."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from diffusio.llm import alignment, exactdup, manifest
from diffusio.llm.queries import tokenizer_path
from tests.llm.plain import sha

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, kept string, digest string"


def rows_of_documents():
    """Copies, blanks, ties, nulls in all columns, odd characters, long texts; the last two columns clash with names in use."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "naïve", "日本語", " x", "</s>", "<|endoftext|>", "<0x41>", "a▁b", "🎈🎈", "0x3fA9", "\x00"]
    out = []
    for i in range(150):
        text = rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
        out.append((3 * i, rng.choice(["big", "big", "Small", "é", None]), rng.choice(["en", None]), len(text), text))
    for k, gap in enumerate(["", " ", "\t\n", "   "]):
        out.append((700 - k, "big", "en", 5, f"same{gap}text"))
    out += [(800, "", "en", 0, ""), (801, "one", None, None, None), (802, "big", "en", 3, " \t\n"), (803, "big", "en", 3, "\n\n ")]
    out += [(900, "big", "en", 4, "twin")] * 3 + [(None, "big", "en", 4, "twin"), (None, "big", None, 9, "only here")]
    out += [(901, "big", "en", 200_000, "ab " * 60_000 + "x" * 20_000), (902, "big", "en", 3, "a" * 50_000), (903, "big", "en", 3, "A" * 50_000)]
    return out


def table(spark, rows=None, parts=7):
    rows = rows_of_documents() if rows is None else rows
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLUMNS).repartition(parts)


def equal_groups(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each row, as a count."""
    groups = defaultdict(list)
    for k, (doc, *_, text) in enumerate(rows):
        said = "".join(c for c in text or "" if c not in " \t\n\v\f\r")
        groups[said].append((-len(text or ""), doc is None, doc or 0, k, doc))
    out = Counter()
    for said, group in groups.items():
        group.sort()
        for g in group:
            out[(g[4], group[0][4], len(group), g[3] == group[0][3], sha(said))] += 1
    return out


@pytest.mark.parametrize("table_bytes, hot, chunk", [(exactdup.TABLE_BYTES, 1000, 100_000), (3_000, 1000, 3), (60, 2, 3)])
def test_exact_duplicates(spark, monkeypatch, table_bytes, hot, chunk):
    monkeypatch.setattr(exactdup, "CHUNK_ROWS", chunk)  # few: many records of one content
    rows = rows_of_documents() if table_bytes > 60 else rows_of_documents()[120:165]
    got = exactdup.exact_duplicates(table(spark, rows), table_bytes, hot)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chars"]
    assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in got.collect()) == equal_groups(rows)


def test_equal_hashes_are_told_apart():
    t = exactdup.ContentTable()
    names = [f"content {i}".encode() for i in range(3000)]
    assert [t.add(i % 7, n) for i, n in enumerate(names)] == list(range(3000))  # seven hashes
    assert [t.find(i % 7, n) for i, n in enumerate(names)] == list(range(3000))
    assert t.find(0, b"content 1") == t.find(3, b"") == -1


def test_spilled_contents_are_whole(spark):
    """A table that is full counts what it has and spills all else, copies together."""
    done = exactdup._bucket(10, False)
    import pyarrow as pa

    rows = [(k, ord(c[0]), c.encode() * 3, 1, 3, k, k, 0) for k, c in enumerate("abcabcdabcd")]
    names = ["record", "h", "content", "size", "best_chars", "best_doc", "best_record", "best_place"]
    out = pa.Table.from_batches(done(iter([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])]))).to_pylist()
    spilled = Counter(r["content"] for r in out if r["spilled"])
    found = Counter((r["entry"], r["size"]) for r in out if not r["spilled"])
    assert spilled == {b"ccc": 3, b"ddd": 2} and found == {(0, 3): 3, (1, 3): 3}


def test_exact_duplicates_without_rows_and_dropping(spark):
    assert exactdup.exact_duplicates(table(spark).limit(0)).count() == 0
    rows = rows_of_documents()
    kept = exactdup.drop_exact_duplicates(table(spark))
    assert kept.columns == table(spark).columns
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got == Counter(doc for (doc, _, _, k, _), n in equal_groups(rows).items() if k for _ in range(n))


def test_exact_duplicates_of_a_query(spark, tmp_path):
    from diffusio.llm.queries import QUERIES

    rows = [r for r in rows_of_documents() if r[0] is not None]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_exact_dedup"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == equal_groups(rows)


# the manifest


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(digests):
    """The root, and for each leaf its siblings level by level as (before, after)."""
    paths, level, owners = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for r, run in enumerate(runs):
            for k in range(len(run)):
                for i in owners[16 * r + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        owners = [sum(owners[16 * r : 16 * r + 16], []) for r in range(len(runs))]
        level = [sha("".join(run)) for run in runs]
    return level[0], paths


def plain_proofs(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, as a count."""
    by_source = defaultdict(list)
    for r in rows:
        low = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if low else r[4]
        leaf, other = (sha("".join(map(field, (*r[:4], t)))) for t in (r[4], seen))
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf, other, r[0]))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort()
        trees[s] = plain_tree([x[2] for x in by_source[s]])
    root, above = plain_tree([trees[s][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for x, path in zip(by_source[s], trees[s][1], strict=True):
            path, at = path + above[k], x[3]
            for a, b in path:
                at = sha(a + at + b)
            out[(x[4], x[2], trees[s][0], root, sha("".join(a + b for a, b in path)), at, at == root)] += 1
    return out


def got_proofs(df):
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


@pytest.mark.parametrize("case", ["odd", "one", "hot"])
def test_proofs(spark, tmp_path, case):
    from diffusio.llm.queries import QUERIES

    rows = rows_of_documents()
    if case == "one":
        rows = rows[:1]
    elif case == "hot":  # 16**2 and more of one source, one of 17 and one of 16, and two levels of sources
        rows = [(i, "a" if i < 16 else "b" if i < 33 else f"s{i}" if i < 60 else "hot", "en", i, f"Text {i}") for i in range(16 * 16 + 80)]
    table(spark, rows, 5).write.parquet(f"{tmp_path}/documents.parquet")
    assert got_proofs(QUERIES["op12_merkle_manifest"](spark, str(tmp_path))) == plain_proofs(rows)


def test_proofs_without_rows(spark):
    assert manifest.prove(table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 600])
def test_mountains_from_any_places(n):
    """Tasks that begin and end anywhere give each inner node once, or the edges that it is made of."""
    leaves = [sha(str(i)) for i in range(n)]
    rng = random.Random(n)
    for bounds in ([], sorted(rng.sample(range(n), min(n, 4))), list(range(n))):
        nodes, edges = {}, {}
        for lo, hi in zip([0, *bounds], [*bounds, n], strict=True):
            m = manifest.Mountains(n, lo)
            found = [x for d in leaves[lo:hi] for x in m.push(d)] + list(m.close())
            for level, at, digest, kids in found:
                put = edges if kids is None else nodes
                assert (level, at) not in put
                put[(level, at)] = digest
                assert kids is None or digest == sha("".join(kids))
        sizes = manifest.lengths(n)
        for level in range(len(sizes) - 1):  # merged as Spark does
            for at in range(sizes[level + 1]):
                if (level + 1, at) not in nodes:
                    run = [edges.get((level, k)) or nodes[(level, k)] for k in range(16 * at, min(16 * at + 16, sizes[level]))]
                    nodes[(level + 1, at)] = sha("".join(run))
        assert (nodes or edges)[(len(sizes) - 1, 0)] == plain_tree(leaves)[0]
        if not bounds and n > 1:
            assert not edges  # one task closes every run


# alignment


def plain_alignment(rows, a_side, b_side):
    """Columns of each row by comparing sets of ends, as a list in the order of rows."""
    made, held = [], Counter()
    for doc, *_, text in rows:
        text = text or ""
        a, b = a_side.encode([" " + text])[0], b_side.encode([text])[0]
        if not text or any(b"".join(s.bytes[i] for i in ids) != (" " + text).encode() for s, ids in ((a_side, a), (b_side, b))):
            made.append((doc, [], []))
            continue
        ends = [[sum(len(s.bytes[i]) for i in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 300 else np.cumsum([len(s.bytes[i]) for i in ids]).tolist() for s, ids in ((a_side, a), (b_side, b))]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            ii, jj = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((a[i:ii], b[j:jj]))
            i, j = ii, jj
        pairs = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(pairs.keys())
        made.append((doc, groups, pairs))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = Counter()
    for doc, groups, pairs in made:
        listed = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        n = Counter(pairs)
        out[(doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(n.values()), sum(c for p, c in n.items() if held[p] == best[p[0]]), sum(c * held[p] for p, c in n.items()), sha256(listed.encode()).hexdigest() if groups else "")] += 1
    return out


@pytest.fixture(scope="module")
def sides():
    import public_tokenizers

    a, b = tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model")
    return a, b, alignment._side(alignment.ByteTokens, a), alignment._side(alignment.PieceTokens, b)


@pytest.mark.parametrize("block, most", [(alignment.BLOCK_BYTES, alignment.MOST_LINKS), (300, 3)])
def test_alignment(spark, monkeypatch, sides, block, most):
    import public_tokenizers

    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "MOST_LINKS", most)
    a, b, a_side, b_side = sides
    rows = [(r[0], *r[1:4], r[4] if r[4] is None else r[4][:100_000]) for r in rows_of_documents()]
    got = alignment.align(table(spark, rows), a, b).collect()
    want = plain_alignment(rows, a_side, b_side)
    assert Counter(tuple(r) for r in got) == want
    assert sum(1 for w in want if w[3] == 0) >= 4 and sum(1 for w in want if w[5] < w[4]) > 20
    assert public_tokenizers.path("byte_bpe_50k.json") == a


def test_alignment_without_rows(spark, sides):
    assert alignment.align(table(spark).limit(0), *sides[:2]).count() == 0
    assert alignment.align(table(spark, [(1, None, None, None, None)]), *sides[:2]).collect()[0][:] == (1, 0, 0, 0, 0, 0, 0, "")


def test_alignment_of_a_query(spark, sides, tmp_path):
    from diffusio.llm.queries import QUERIES

    rows = rows_of_documents()[:60]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op11_cross_tokenizer_alignment"](spark, str(tmp_path))
    assert Counter(tuple(r) for r in df.collect()) == plain_alignment(rows, *sides[2:])


def test_groups_of_a_text(sides):
    a, b, a_side, b_side = sides
    for text in ("Hello, naïve 日本語 world 🎈", "x" * 99, "a▁b", ""):
        groups = alignment.token_groups(text, a, b)
        said = b" " + text.encode() if groups else b""
        assert b"".join(a_side.bytes[i] for xs, _ in groups for i in xs) == said == b"".join(b_side.bytes[i] for _, ys in groups for i in ys)
        assert all(b"".join(a_side.bytes[i] for i in xs) == b"".join(b_side.bytes[i] for i in ys) for xs, ys in groups)
    assert not alignment.token_groups("a▁b", a, b)


def test_marks():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        ends = np.unique(rng.integers(1, size + 1, max(1, size // 3)))
        m = alignment.Marks.of(ends, size)
        at = np.arange(size + 1)
        assert m.select().tolist() == ends.tolist()
        assert m.rank(at).tolist() == [int((ends <= x).sum()) for x in at]


def test_wide_groups_count_as_pairs():
    a, b = np.array([1, 2, 1, 3] * 40), np.array([5, 5, 6] * 60)
    want = Counter((x, y) for x in a.tolist() for y in b.tolist())
    for to_a, to_b, expect in ((np.array([160]), np.array([180]), want),):
        keys, times = alignment.links(a, b, to_a, to_b)
        assert {(k >> 32, k & 0xFFFFFFFF): n for k, n in zip(keys.tolist(), times.tolist(), strict=True)} == expect
