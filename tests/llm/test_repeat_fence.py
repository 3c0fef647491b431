from diffusio.llm import quality


def repeating(i, times):
    """100 words, of which a passage of 5 occurs some times."""
    passage = [f"p{i}x{j}" for j in range(5)]
    return " ".join(" ".join([*passage, f"s{i}x{k}"]) for k in range(times)) + " " + " ".join(f"w{i}x{j}" for j in range(100 - 6 * times))


def test_repeats_fail_where_they_are_rare(spark):
    rows = [(i, repeating(i, 1), "en", "clean") for i in range(200)] + [(1000 + i, repeating(i, 3), "en", "lists") for i in range(200)]
    rows += [(2000, repeating(2000, 3), "en", "clean"), (2001, repeating(2001, 2), "en", "clean"), (2002, repeating(2002, 4), "en", "lists"), (2003, repeating(2003, 5), "en", "lists")]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [(got[i]["n_words"], got[i]["n_repeat_words"], got[i]["base_failed"]) for i in (2000, 1000)] == [(100, 15, False)] * 2
    assert {i for i, r in got.items() if not r["kept"]} == {2000, 2003}  # 15 percent where none is usual, and 25 anywhere


def test_junk_does_not_lift_the_fence(spark):
    rows = [(i, repeating(i, 1), "en", "clean") for i in range(200)] + [(1000 + i, "same words again and again " * 20, "en", "clean") for i in range(60)] + [(2000, repeating(2000, 3), "en", "clean")]
    got = {r["doc_id"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert got == set(range(200))
