"""What counts as a letter, and the bound on the rows that the language model learns from."""

from tidewatch.llm import language

DOCS = "doc_id long, text string, lang string"


def test_letters_are_the_category_l(spark):
    """Fractions, superscripts and circled digits are no letters; letters of every script are."""
    base = [(i, "the quick brown fox jumps over dogs " * 3, "en") for i in range(20)] + [(100 + i, "der schnelle braune Fuchs springt über Hunde " * 3, "de") for i in range(20)]
    odd = [(200, "½ ² ① 42 _", None), (201, "", None), (202, None, None), (203, "Привет", None), (204, "中", None), (205, "ª", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(spark.createDataFrame(base + odd, DOCS)).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0)
    assert all(got[i][0] in ("en", "de") and got[i][1] > 0 for i in (0, 100, 203, 204, 205))


def test_repeated_ids_do_not_fill_the_sample(spark):
    """Five thousand rows of one id teach as one row of each length."""
    rows = [(7, f"word {i % 10} and more", "en") for i in range(5_000)] + [(8, "ein Wort und mehr", "de")]
    known = spark.createDataFrame(rows, DOCS)
    seen = []
    fit = language.fit
    try:
        language.fit = lambda data, at, langs: seen.append(len(data)) or fit(data, at, langs)
        language.learn(known, 10, 20)
    finally:
        language.fit = fit
    assert seen and seen[0] <= 2 * 20
