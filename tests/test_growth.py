"""Work that must grow no faster than the input: bytes shuffled and rows made on inputs that once multiplied them."""

from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import markup
from millrace.operators import chains
from millrace.operators import keyword_index as K
from millrace.operators import ordered as O
from millrace.operators import relations as R
from millrace.operators.access import pending
from millrace.operators.evaluation import weight_grid
from millrace.operators.retrieval import bm25_search, boolean_search
from millrace.sources.files import written


def shuffled(spark, run) -> int:
    """Bytes that the stages of an action write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))
    before = written()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return written() - before


def test_a_text_is_not_moved_once_for_each_of_its_words(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.md5((i * 7 + F.col("doc") % 2).cast("string")))
    texts = spark.range(0, 8, 1, 4).withColumnRenamed("id", "doc").withColumn("words", words)
    phrases = texts.filter("doc < 2").select(F.col("doc").alias("item"), F.slice("words", 5, 6).alias("words"))
    found = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = shuffled(spark, lambda: found.extend(R.token_subset_pairs(texts, "doc", phrases, "item", "words").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in found} == {(d, d % 2) for d in range(8)}
    assert 0 < moved < 10 * 8 * 400 * 32


def test_copies_are_searched_once(spark, tmp_path):
    docs = spark.range(0, 3000, 1, 4).select("id", F.when(F.col("id") % 2 == 0, "old brake pad").otherwise("brake hose").alias("a"))
    asked = spark.range(0, 300, 1, 4).select(F.col("id").alias("query_id"), F.lit("Brake pad").alias("text"))
    index = K.write_keyword_index(docs, "id", {"a": "a"}, f"file://{tmp_path}/copies", stems=False)
    searches = [
        (900_000, lambda: bm25_search(docs, "id", {"a": "a"}, {"a": 1}, asked)),
        (450_000, lambda: boolean_search(docs, "id", "a", asked)),
        (900_000, lambda: K.search_keywords(index, asked, {"a": 1})),
        (450_000, lambda: K.search_phrases(index, asked, "a")),
        (0, lambda: K.absent(index, asked)),
    ]
    for rows, search in searches:
        found = []
        assert shuffled(spark, lambda: found.append(search().count())) < 500_000
        assert found == [rows]


def test_first_others_make_no_pairs_of_a_group(spark):
    rows = [(i, "a" if i % 5 else None, i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, size int")
    near, plain = set(), set()
    for i, g, n in rows:
        same = [(abs(n - m), j) for j, h, m in rows if g and g == h and i != j]
        near |= {(i, j) for _, j in sorted(x for x in same if x[0] <= 2)[:12]}
        plain |= {(i, j) for j in sorted(j for _, j in same)[:5]}
    assert {tuple(r) for r in O.first_others(df, "id", ["g"], 12, "size", 2).collect()} == near
    assert {tuple(r) for r in O.first_others(df, "id", ["g"], 5).collect()} == plain
    one = spark.range(0, 20_000, 1, 4).select("id", F.lit("a").alias("g"), (F.col("id") % 7).alias("size"))
    assert shuffled(spark, lambda: O.first_others(one, "id", ["g"], 12, "size", 2).count()) < 3_000_000


def test_side_lookup_words_end_at_letters_with_accents(spark, tmp_path):
    texts = ["éla", "la", "dela", "theé", "the2", "of_", "x of y", None]
    spark.createDataFrame([(50, i, "user", x) for i, x in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, 1, 2.0)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"file://{tmp_path}/part.parquet")
    found = catalog.queries()["ret25_side_lookups"](spark, f"file://{tmp_path}").collect()
    assert sorted((r.turn, r.p_partkey) for r in found) == [(0, 7), (1, 7), (3, 7), (6, 7)]


def test_pages_of_one_small_file_are_read_by_many_tasks(spark):
    pages = spark.range(0, 400, 1, 1).select("id", F.lit('<a href="x.html">x</a><ul><li>a</li></ul><table><tr><td>1</td></tr></table>').alias("html"))
    for read in (markup.anchors, markup.table_rows):
        tasks = read(pages, "html").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert len(tasks) >= 4 and sum(r.n for r in tasks) == 400


def test_tasks_grow_with_the_rows_and_rows_move_once(spark, tmp_path):
    many = spark.range(0, 1000, 1, 1)
    assert O.dealt(many, "id", rows_per_task=10).rdd.getNumPartitions() == 100 and O.dealt(many, "id").rdd.getNumPartitions() == 4
    lines = spark.range(0, 4000, 1, 4).select((F.col("id") % 500).alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"), F.lit(1).alias("l_suppkey"), (F.col("id") / 500).cast("int").alias("l_linenumber"), (F.col("id") % 13).cast("double").alias("l_quantity"), (F.col("id") % 11).cast("double").alias("l_extendedprice"), F.lit(0.1).alias("l_discount"), F.lit(0.2).alias("l_tax"), F.when(F.col("id") % 2 == 0, "R").otherwise("A").alias("l_returnflag"))
    lines.write.parquet(f"file://{tmp_path}/lineitem.parquet")
    for name in ("ret23_phrasings", "dia7_symptom_path", "set15_keep_first_conflicts"):
        df = catalog.queries()[name](spark, f"file://{tmp_path}")
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1, name


def test_pending_moves_keys_once(spark):
    log = spark.range(0, 40_000, 1, 4).select((F.col("id") % 12).cast("string").alias("car"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        assert shuffled(spark, lambda: found.extend(pending(log, log.filter("car < '5'"), "car").collect())) < 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.car for r in found) == ["5", "6", "7", "8", "9"]


def test_a_grid_of_weights_moves_each_row_once(spark):
    scores = spark.range(0, 20_000, 1, 4).select((F.col("id") % 2).alias("fold"), F.col("id").alias("query_id"), F.lit(1).alias("item"), F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 3 == 0).cast("double").alias("target"))
    moved = [shuffled(spark, lambda: weight_grid(scores, "a", "b", "target", "fold", weights).collect()) for weights in ([0.5], [k / 20 for k in range(21)])]
    assert moved[1] < 1.5 * moved[0]


def test_ranges_of_a_chain_hold_a_bounded_number_of_rows(spark, monkeypatch):
    rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 2).alias("key"), (F.col("id") * 3).alias("t"), "id")
    made = []
    monkeypatch.setattr(chains, "written", lambda df, label: made.append(written(df, label)) or made[-1])
    kept = sorted(r.id for r in chains.spaced(rows, ["key"], F.col("t"), "id", 20, rows_per_range=100).collect())
    want, last = [], {}
    for i in range(4000):
        if i % 2 not in last or 3 * i - last[i % 2] > 20:
            want.append(i)
            last[i % 2] = 3 * i
    assert kept == want
    sizes = [r.n for r in made[0].groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 30 and max(sizes) < 400
