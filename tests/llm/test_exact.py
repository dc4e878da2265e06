import hashlib
import re
from collections import Counter, defaultdict

from fixtures_llm import ROWS
from pyspark.sql import functions as F

from candlewick.llm import exact, mixing, queries, simhash, substring


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    out = []
    for members in groups.values():
        keep, chars = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        out += [(i, keep, len(members), i == keep and n == chars) for i, n in members]
    return Counter(out)


def test_groups_equal_brute_force(docs):
    got = exact.exact_groups(docs).collect()
    assert Counter(map(tuple, got)) == brute(ROWS)


def test_kept_rows_are_one_of_each_text(docs):
    left = exact.drop_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ROWS})


def test_empty_table(no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    assert exact.drop_exact_copies(no_docs).count() == 0


def test_query_has_the_digest_of_every_row(spark, sf):
    got = queries.op9_exact_dedup(spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(texts)
    for r in got:
        assert r.text_sha256 == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", texts[r.doc_id] or "").encode()).hexdigest()


def test_one_row_stays_of_an_id_whose_texts_differ_in_white_space(spark):
    rows = [(1, "a b"), (1, "a\tb"), (1, "a b"), (None, "c d"), (None, "c\nd"), (2, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text.split()[0] for r in exact.drop_exact_copies(df).collect()) == ["a", "c", "e"]
    kept = Counter(r.keep_id for r in exact.exact_groups(df).collect() if r.kept)
    assert kept[None] == kept[2] == 1 and kept[1] in (1, 2)  # identical rows are kept together


def test_ids_of_any_type_and_clashing_names(spark):
    rows = [("b", "x y"), ("a", "xy"), (None, "x y"), ("c", "z")]
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"b": ("b", True), "a": ("b", False), None: ("b", False), "c": ("c", True)}
    least = -(1 << 63)
    got = exact.exact_groups(spark.createDataFrame([(least, "q"), (5, "q")], "doc_id long, text string")).collect()
    assert {r.keep_id for r in got} == {least}
    names = "doc_id long, text string, _k_id string, _K_TEXT string, _k_id2 int"
    df = spark.createDataFrame([(1, "x y", "u", "v", 1), (2, "xy", "u", "v", 2), (1, "x y", "u", "v", 3), (3, "w", None, None, 4)], names)
    left = exact.drop_exact_copies(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]
    assert simhash.drop_near_copies(df).columns == df.columns and simhash.drop_near_copies(df).count() >= 1
    assert mixing.mix(df.withColumns({"source": F.lit("s"), "_m_s": F.lit(1)})).count() >= 1


def test_small_integer_ids(spark):
    df = spark.createDataFrame([(1, "a " * 40), (2, "a " * 40)], "doc_id long, text string")
    for kind in ("smallint", "string", "decimal(9,0)"):
        got = substring.cut_repeats(df.withColumn("doc_id", F.col("doc_id").cast(kind))).collect()
        assert sum(r.n_removed for r in got) == 80, kind
