import re
import uuid

from pyspark.sql import functions as F

from tessera.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_query_tokens_keep_underscores_and_fall_back(spark):
    assert one(spark, tx.content_tokens(F.lit("What is OEP_Working of VM.Standard.E4?"))) == ["oep_working", "vm", "standard", "e4"]
    assert one(spark, tx.content_tokens(F.lit("what is the"))) == ["what", "is", "the"]
    assert one(spark, tx.content_tokens(F.lit("?!"))) == []


def test_index_tokens_split_underscores_and_fold_marks(spark):
    assert one(spark, tx.index_tokens(F.lit("OEP_Working Café-Élan"))) == ["oep", "working", "cafe", "elan"]
    assert one(spark, tx.index_tokens(F.lit(None).cast("string"))) == []


def test_identifiers_make_a_query_lexical(spark):
    for text, want in [("use oep_working", True), ("VM.Standard.E4.Flex", True), ("a.b", False), ("plain words", False)]:
        assert one(spark, tx.is_lexical(F.lit(text))) is want, text


def test_uuid5_equals_python(spark):
    names = ["erp-gl:0", "x:17", "ü:3"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.uuid5(F.col("n")).alias("u"))
    assert {r.n: r.u for r in df.collect()} == {n: str(uuid.uuid5(tx.NAMESPACE, n)) for n in names}


def test_headings_titles_and_snippets(spark):
    assert one(spark, tx.clean_heading(F.lit("1.2.3 Journals"))) == "Journals"
    assert one(spark, tx.clean_heading(F.lit("42 "))) == "42 "
    assert one(spark, tx.title_fallback(F.lit("vm2x-guide_a"))) == "Vm2X Guide A"
    assert one(spark, tx.snippet(F.lit(" a \n\t b  c "), 3)) == "a b"


def test_urls(spark):
    assert one(spark, tx.slug_for_url(F.lit("https://h/x/Content/Security/Some-Page.htm#a"))) == "Security_Some_Page.html"
    assert one(spark, tx.slug_for_url(F.lit("https://h/"))) == "index.html"
    scope = lambda u: one(spark, tx.in_scope(F.lit(u), "https://h/", "https://h/s/"))
    assert scope("https://h/s/a.HTML#x") and not scope("https://h/t/a.html") and not scope("https://h/s/a.pdf")
    df = spark.createDataFrame([("https://h/a/b.html", "../c.html")], "b string, l string")
    assert df.select(tx.join_url("b", "l").alias("u")).first().u == "https://h/c.html"


def test_scores_and_grades(spark):
    for value, want in [("3", 3), ("4.9", 4), ("9", 5), ("-1", 0), ("n/a", 0), (None, 0)]:
        assert one(spark, tx.score(F.lit(value).cast("string"))) == want, value
    assert one(spark, tx.grade(F.lit("2.7"))) == 0 and one(spark, tx.grade(F.lit("7"))) == 3


def test_category_and_mentions(spark):
    cat = lambda i, t, p: one(spark, tx.category(F.lit(i), F.lit(t).cast("string"), F.array(*map(F.lit, p))))
    assert [cat("q", "exact_term", ["a"]), cat("adv-1", None, ["a"]), cat("q", None, ["a", "b"]), cat("q", None, ["a"])] == ["exact_term", "adversarial", "cross", "single"]
    assert one(spark, tx.mentions(F.lit("General LEDGER"), F.array(F.lit("ledger"))))


def test_python_word_rule_agrees(spark):
    text = "naïve café_1 ünï.x ß"
    assert one(spark, tx.query_tokens(F.lit(text))) == re.findall(r"\w+", text.lower())


def test_index_terms_equal_fts5_on_every_marked_letter(spark):
    """Each letter and mark of the Latin blocks inside a word, and a word with marks that stand apart."""
    import sqlite3

    from pyspark.sql import functions as F

    from tessera.functions import text as tx

    words = [f"q{chr(i)}z" for i in [*range(0xC0, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00)]] + ["re\u0301sume\u0301"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x)")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(words, 1)))
    want = {}
    for term, doc, _ in con.execute("select term, doc, offset from v order by doc, offset"):
        want.setdefault(doc, []).append(term)
    rows = spark.createDataFrame(list(enumerate(words, 1)), "i int, w string").select("i", tx.index_tokens(F.col("w")).alias("t")).collect()
    assert [(words[r.i - 1], r.t) for r in rows if r.t != want.get(r.i, [])] == []


def test_path_and_text_without_path(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as tx

    got = spark.range(1).select(tx.with_path(F.array().cast("array<string>"), F.lit("abc")).alias("a"), tx.with_path(F.array(F.lit("x"), F.lit("y")), F.lit("abc\t")).alias("b")).first()
    assert (got.a, got.b) == ("abc", "x > y\nabc")
