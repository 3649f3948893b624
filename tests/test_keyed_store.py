"""Lasting stores: upserts, snapshots and plans."""

import pytest

from cuesheaf.operators import pages, translate
from cuesheaf.sources.keyed_store import KeyedStore, memory_store, page_store

ROW = "k long, a string, b long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_replace_rows_of_their_key(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", ROW, "k", 4)
    assert rows(store.current()) == []
    store.upsert(spark.createDataFrame([(1, "x", 1), (2, "y", 2), (None, "z", 3), (2, "yy", 0)], ROW))
    assert rows(store.current()) == [(1, "x", 1), (2, "yy", 0)]
    before = store.current()
    store.upsert(spark.createDataFrame([(2, "new", 5), (3, None, None)], ROW))
    assert rows(store.current()) == [(1, "x", 1), (2, "new", 5), (3, None, None)]
    assert rows(before) == [(1, "x", 1), (2, "yy", 0)]  # a reader of the snapshot before goes on
    again = KeyedStore(spark, f"file://{tmp_path}/s", ROW, "k", 4)
    spark.sql(f"DROP TABLE {again.name}_v2")  # as in another session
    assert rows(again.current()) == rows(store.current()) and again.version() == 2
    store.upsert(spark.createDataFrame([], ROW))
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["pointers", "v2", "v3"]


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", ROW, "k", 4)
    store.upsert(spark.createDataFrame([(1, "x", 1)], ROW))
    with pytest.raises(Exception, match="lost"):
        store.upsert(spark.range(9).selectExpr("id AS k", "IF(id = 7, raise_error('lost'), 'a') AS a", "id AS b"))
    assert store.version() == 1 and rows(store.current()) == [(1, "x", 1)]
    store.upsert(spark.createDataFrame([(2, "y", 2)], ROW))
    assert rows(store.current()) == [(1, "x", 1), (2, "y", 2)]


def test_lookups_do_not_move_the_store(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store = page_store(spark, f"file://{tmp_path}/p", 4)
        stored = spark.createDataFrame([(k, f"http://h/{k}", "x") for k in range(50)], "page_id long, url string, html string")
        store.upsert(pages.keyed_pages(stored, "d"))
        asked = stored.select("url").unionByName(spark.createDataFrame([("http://h/none",)], "url string"))
        found = pages.stored_page_lookup(asked, store.current(), "d")
        assert found.filter("missing").count() == 1 and found.filter("page_id IS NOT NULL").count() == 50
        memory = memory_store(spark, f"file://{tmp_path}/m", "en", "xx", 4)
        memory.upsert(spark.createDataFrame([("a", "en", "xx", "A"), ("b", "en", "xx", "B")], "text string, src string, tgt string, translation string"))
        cues = spark.createDataFrame([(1, k, k, k, t, 0.0) for k, t in enumerate(["a", "c", "<i>b</i>", ""])], "media_id long, seq long, start_ms long, end_ms long, text string, confidence double")
        missing = translate.missing_translations(cues, memory.current(), "en", "xx")
        assert rows(missing) == [("c",)]
        known = translate.translate_from_memory(cues, memory.current(), spark.createDataFrame([], "word string, gloss string"), "en", "xx")
        for df in (found, missing, known):
            plan = df._jdf.queryExecution().executedPlan().toString()
            store_side = [part for part in plan.split("Exchange hashpartitioning") if "Bucketed: true" in part]
            assert "Bucketed: true" in plan and "SortMergeJoin" in plan
            scan = next(k for k, line in enumerate(plan.splitlines()) if "Bucketed: true" in line)
            depth = plan.splitlines()[scan].index("FileScan")
            above = []
            for line in reversed(plan.splitlines()[:scan]):  # the nodes between the scan and its join
                at = next(i for i, c in enumerate(line) if c.isalpha() or c == "*")
                if at < depth:
                    depth = at
                    above.append(line)
                    if "Join" in line:
                        break
            assert store_side and above and not any("Exchange" in line for line in above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


SHARED = [(0, "http://h/a", "old"), (1, "http://h/b", "b"), (2, "http://h/a", "new"), (3, "http://h/a", None)]


@pytest.mark.parametrize("lasting", [False, True])
def test_pages_of_one_address_are_all_found(spark, tmp_path, lasting):
    kept = spark.createDataFrame(SHARED, "page_id long, url string, html string")

    def look(asked):
        if not lasting:
            return pages.page_store_lookup(asked, kept.union(kept), "d")
        store = page_store(spark, f"file://{tmp_path}/s", 4)
        for part in (kept.filter("page_id = 2").withColumn("html", pages.F.lit("first")), kept, kept.filter("page_id < 2")):
            store.upsert(pages.keyed_pages(part, "d"))
        return pages.stored_page_lookup(asked, store.current(), "d")

    asked = kept.select((kept.page_id * 10).alias("request"), "url", "page_id").union(kept.selectExpr("page_id * 10 + 1", "url || '&absent'", "page_id"))
    found = look(asked.union(spark.createDataFrame([(100, "http://h/a", 1), (101, "http://h/a", None)], asked.schema)))
    assert rows(found.select("request", "page_id", "html", "missing")) == rows(spark.createDataFrame(
        [(p * 10, p, h, False) for p, _, h in SHARED] + [(p * 10 + 1, None, None, True) for p, _, _ in SHARED] + [(100, None, None, True), (101, 3, None, False)],
        "request long, page_id long, html string, missing boolean"))
    assert rows(look(kept.select("url").distinct()).select("url", "page_id")) == [("http://h/a", 3), ("http://h/b", 1)]


@pytest.mark.parametrize("name", ["page_store_lookup", "stored_page_lookup"])
def test_lookup_queries_on_shared_addresses(spark, tmp_path, name):
    import duckdb

    from cuesheaf.plans import registry

    spark.createDataFrame(SHARED, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert rows(registry.QUERIES[name](spark, str(tmp_path))) == sorted(con.execute(registry.ORACLES[name]).fetchall(), key=repr)
