import pytest

from pagemill.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_sql(name, same_rows):
    same_rows(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(name, spark):
    from conftest import SF

    assert registry.queries()[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_texts_reach_the_queries(spark):
    """Slugs, outlines and the chunks' pages are those of whole texts and of all pages."""
    from pyspark.sql import functions as F

    from conftest import SF
    from pagemill.plans import bindings, corpus_queries

    queries = registry.queries()
    docs = {r.doc_id: (r.text or "").strip(" ") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    long = [i for i, t in docs.items() if len(t) > 500]
    slugs = {r.doc_id: r.slug for r in queries["b3_slugify"](spark, SF).collect()}
    assert len(long) > 50 and all(len(slugs[i]) > 60 for i in long)
    lang = {r.doc_id: r.lang or "none" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pages = {(r.book_id, r.physical_page): r.combined_text for r in corpus_queries._text(spark, SF).collect()}
    assert len(pages) == len(docs) and all(docs[i] in pages[lang[i], i + 1] for i in docs)
    titled = bindings.pages(spark, SF).where(F.length(F.trim(F.split("text", "\n")[0])) > 40).select("deck_id").distinct().count()
    assert queries["s1_outline_items"](spark, SF).select("deck_id").distinct().count() >= titled
    assert queries["s1_outline_items"](spark, SF).count() > len(docs) / 3
