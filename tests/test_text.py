import pytest
from pyspark.sql import functions as F

from recordloom.functions import fingerprint as fp
from recordloom.functions import text as tx


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "c string").select(make("c").alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, value, want",
    [
        (tx.normalized_name, "Ernst & Young Inc.", "ernst and young inc"),
        (tx.normalized_name, "TILVA  PORT", "tilva port"),
        (tx.normalized_name, "Société Générale", "société générale"),
        (tx.normalized_name, None, ""),
        (tx.slug, "  Hello, World_Again -- x! ", "hello-world-again-x"),
        (tx.doc_slug, "folder/Annual Report 2020.pdf", "annual-report-2020"),
        (tx.doc_slug, "!!!.pdf", "document"),
        (tx.tokens, "Foo bar_baz café 12 x-y", ["foo", "12", "x", "y"]),
        (tx.est_tokens, "abcdefg", 1),
        (tx.is_garbled, "###$$$%%%ab", True),
        (tx.is_garbled, "   ", False),
        (tx.is_garbled, "plain words, mostly", False),
        (tx.render_date, "2020-03-15", "15 Mar 2020"),
        (tx.render_date, "2020-03", "March 2020"),
        (tx.render_date, "2020", "2020"),
        (tx.render_date, "2020-13-45", "2020-13-45"),
        (tx.date_key, "2020", "2020-00-00"),
        (tx.date_key, "2020-05", "2020-05-00"),
        (tx.year_of, "", "Unknown"),
        (tx.strip_frontmatter, "---\na: b\n---\nBody\n", "Body"),
        (tx.strip_frontmatter, "no front\n---\nmatter", "no front\n---\nmatter"),
        (tx.wiki_links, "see [[a/b|B]] and [[c]]", ["a/b", "c"]),
        (tx.html_text, "<p>a &amp; b</p><script>x</script><!-- c --><nav>n</nav>d", "a & b d"),
        (tx.file_stem, "x/.hidden", ".hidden"),
        (tx.human_size, "2048", "2.0 KB"),
        (tx.page_label, "1", "1 page"),
        (tx.eta, "45", "45s"),
        (tx.eta, "125", "2m 05s"),
        (tx.eta, "3785", "1h 03m"),
    ],
)
def test_functions(spark, make, value, want):
    assert one(spark, make, value) == want


def test_sections_of_notes(spark):
    note = "# T\n\n## Summary\n\nline one\nline two\n\n## Timeline\n\n- x\n"
    assert one(spark, lambda c: tx.section(c, "Summary"), note) == "line one\nline two"
    assert one(spark, lambda c: tx.section(c, "Timeline"), note) == "- x"
    assert one(spark, lambda c: tx.section(c, "Missing"), note) == ""


def test_pages_keep_their_numbers(spark):
    pages = one(spark, tx.split_pages, f"first{tx.PAGE_BREAK}  {tx.PAGE_BREAK}third")
    assert [(p["page"], p["markdown"]) for p in pages] == [(1, "first"), (3, "third")]
    assert [(p["page"], p["markdown"]) for p in one(spark, tx.split_pages, None)] == [(1, "")]


def test_signature_parameters():
    assert (fp.A[0], fp.A[1], fp.B[0], fp.B[1]) == (1813382119, 827308000, 1261898043, 617739271)
    assert len(fp.minhash({"a b c"})) == 128 and not fp.minhash(set()).any()
    assert fp.shingles(["a", "b"]) == {"a b"} and fp.shingles([]) == {""}


def test_similarities(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1, 5, 3]), ([], []), ([1], [1, 2])], "a array<long>, b array<long>")
    got = rows.select(fp.similarity(F.col("a"), F.col("b")).alias("s"), fp.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [round(r.s, 4) for r in got] == [0.6667, 0.0, 0.0]
    assert [r.j for r in got] == [0.5, 1.0, 0.5]
