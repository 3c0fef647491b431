import datetime
import math
import random

from diffusio.llm import quality, urls
from tests.llm.plain import measures

D = datetime.date


def test_urls(spark):
    entries = spark.createDataFrame(
        [("bad.org", "block", D(2024, 1, 1)), ("bad.org", "remove", D(2024, 3, 1)), ("ok.bad.org", "allow", D(2024, 2, 1)), ("x.com/ads", "block", D(2024, 1, 1)), ("tie.net", "allow", D(2024, 1, 1)), ("tie.net", "block", D(2024, 1, 1)), (None, "block", D(2024, 1, 1)), ("none.org", "block", None)],
        "key string, action string, effective date",
    )
    rows = [
        (1, "http://a.bad.org/x", D(2024, 1, 1), False, 1), (2, "http://a.bad.org/x", D(2023, 12, 31), True, 0), (3, "http://a.bad.org/x", D(2024, 3, 1), True, 0),
        (4, "https://OK.bad.org:80/", D(2024, 2, 2), True, 2), (5, "http://u@x.com/ads?q", D(2024, 5, 1), False, 1), (6, "http://x.com/adsy", D(2024, 5, 1), True, 0),
        (7, "http://tie.net.", D(2024, 5, 1), False, 1), (8, None, D(2024, 5, 1), True, 0), (9, "", D(2024, 5, 1), True, 0), (10, "http://bad.org", None, True, 0), (11, "http://none.org", D(2024, 5, 1), True, 0), (12, "http://notbad.org", D(2024, 1, 2), True, 0),
    ]
    df = spark.createDataFrame([(*r[:3], "z") for r in rows + rows[:1]], "page_id long, url string, fetched_at date, key string")
    got = urls.filter_urls(df, entries).collect()
    assert sorted((r["page_id"], r["kept"], r["n_active"]) for r in got) == sorted((r[0], r[3], r[4]) for r in rows + rows[:1])
    assert urls.filter_urls(df.limit(0), entries).count() == 0
    assert {r["kept"] for r in urls.filter_urls(df, entries.limit(0)).collect()} == {True}


def texts():
    rep = "one two three four five six seven"
    return [None, "", " \t\n", "a", "x\n\nx\n x\n", "é" * 50 + " ü", f"{rep} {rep}", f"{rep} z {rep} y {rep}", "a " * 300, "b\x0b\x0cc\rd", "<p> & $5 #x\n" * 4, " ".join(f"w{i}" for i in range(3000)), "one two three four five one two three four five one"]


def test_measures(spark):
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in enumerate(texts())], "doc_id long, text string, lang string, source string, w int")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    for i, t in enumerate(texts()):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == measures(t), (i, t)
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(df.limit(0)).count() == 0


def test_fences_adapt(spark):
    plain = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(200)]
    marked = [" ".join(f"# w{i}x{j}" for j in range(30)) for i in range(200)]
    rows = [(i, t, "en", "plain") for i, t in enumerate(plain)] + [(1000 + i, t, "en", "code") for i, t in enumerate(marked)] + [(5000, marked[0], "en", "plain"), (5001, plain[0], "xx", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lost = {r["doc_id"] for r in quality.quality(df).where("NOT kept").collect()}
    assert lost == {5000}  # symbols are usual in one source and not in the other


def test_sketches_are_exact_sums_and_near_quantiles(spark):
    """Quantiles within a percent of those of sorted values, the same for any layout and merged from parts."""
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("ab#") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "fr", None]), rng.choice("xy")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one, two = (quality.measure(df.repartition(n)) for n in (1, 9))
    found = {r["lang"]: r for r in quality.quantiles(quality.sketches(two), "lang").collect()}
    assert found == {r["lang"]: r for r in quality.quantiles(quality.sketches(one), "lang").collect()}
    for lang in ("en", "fr", None):
        values = sorted(sum(len(w) for w in t.split()) / len(t.split()) for _, t, x, _ in rows if x == lang)
        assert found[lang]["n"] == len(values)
        for q, got in zip((0.25, 0.75), found[lang]["word_length"], strict=True):
            assert abs(got / values[math.ceil(q * len(values)) - 1] - 1) < 0.011
    kept = [sorted((r["doc_id"], r["kept"]) for r in quality.quality(df.repartition(n)).collect()) for n in (1, 9)]
    assert kept[0] == kept[1]
