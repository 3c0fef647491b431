"""Each stage of the pipeline against a plain version of its rule, on a folder of small tables."""

import random

import corpus_pipeline as C
from diffusio.llm import secrets, toxicity
from tests.llm.plain import components, contamination
from tests.llm.test_texts import pieces_of, reference_ids

VOCABULARY = [f"w{i}" for i in range(3000)]


def tables(spark, folder):
    rng = random.Random(21)
    say = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(i, " ".join(say(30))) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        t = say(rng.randrange(10, 80))
        if bad := rng.random() < 0.3:
            t[rng.randrange(len(t))] = rng.choice(["vile", "scumbag"])
        docs.append([i, " ".join(t)])
        labels.append((i, 1, int(bad)))
    clean = [d for d, (_, _, bad) in zip(docs, labels, strict=True) if not bad]
    for k in range(40):
        words = clean[k][1].split()
        words[0] = "changed"
        docs.append([1000 + k, clean[k][1] if k % 2 else " ".join(words)])
    docs += [[2000 + k, " ".join([*say(5), *items[k % 5][1].split()[:20], *say(5)])] for k in range(10)]
    docs += [[3000, "key = x, password = abcdefghijklmnop " + " ".join(say(20))], [3001, None], [3002, ""], [None, " ".join(say(30))]]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows + rows[-5:-4], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items, {i for i, _, bad in labels if bad}


def test_stages(spark, tmp_path):
    items, bad = tables(spark, str(tmp_path))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, texts = now.columns, {}
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        rows = now.collect()
        texts = {r["doc_id"]: r["text"] for r in rows}
        assert now.columns == columns
        if name == "toxicity":
            wrong = {i for i in before if (i not in texts) != (i in bad)}
            assert len(wrong) < 0.03 * len(before)
        if name == "near_duplicates":
            found = components([(i, t) for i, t in before.items() if i is not None])
            assert set(texts) == {i for i, (_, least) in found.items() if i == least} | {None} and len(rows) == len(texts)
        if name == "decontamination":
            assert set(texts) == {i for i, t in before.items() if not contamination(t, items)[3]}
        if name == "secrets":
            assert set(texts) == set(before) and not any(secrets.scan_text(t or "") for t in texts.values())
            assert all(texts[i] == t for i, t in before.items() if not secrets.scan_text(t or ""))
    packed = sorted((r["doc_id"] or -1, r["start"], r["length"]) for r in C.STAGES[-1][1](spark, now, str(tmp_path)).collect())
    ids = reference_ids()
    assert packed == sorted((r["doc_id"] or -1, a, n) for r in rows for a, n in pieces_of(len(ids(r["text"])) + 1, 2048))
    assert toxicity.THRESHOLD == 0.3 and C.ORACLE_SQL is None


ROWS = [(1, "A " * 9), (5, "a " * 9), (5, "z y x w v u"), (7, "q r s"), (7, "q r s"), (None, "q r s"), (None, "o n l y"), (None, "o n l y"), (8, ""), (8, ""), (9, None)]


def kept(spark, rows, folder):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, row int, toxicity int, contamination string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    out = {}
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, df, str(folder))
        assert got.columns == df.columns
        out[name] = sorted(((r["doc_id"] or 0, r["text"], r["row"], r["toxicity"], r["contamination"]) for r in got.collect()), key=str)
    return df, out


def test_rows_are_judged_not_ids(spark, tmp_path):
    _, out = kept(spark, ROWS, tmp_path)
    said = [(i, t) for i, t, *_ in out["near_duplicates"]]
    assert said == sorted([(1, "A " * 9), (5, "z y x w v u"), (7, "q r s"), (0, "o n l y"), (8, ""), (8, ""), (9, None)], key=str)
    everything = sorted(((i or 0, t, 1, 2, "x") for i, t in ROWS), key=str)
    assert out["toxicity"] == out["decontamination"] == out["secrets"] == everything


def test_empty_tables(spark, tmp_path):
    df, out = kept(spark, [], tmp_path)
    assert set(map(len, out.values())) == {0} and C.STAGES[-1][1](spark, df, str(tmp_path)).count() == 0
