"""Corpora: rows with an id, a leaf label and its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismview.functions.sampling import sample_key
from prismview.functions.text import clean_document


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation and region."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    places = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # 25 rows
    return read("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("row_id"), F.col("n_name").alias("leaf"), F.col("r_name").alias("grp"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the nation and region of their customer: the large corpus."""
    of = customers(spark, sf_dir).withColumnRenamed("row_id", "c_custkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").join(of, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("row_id"), "leaf", "grp")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with several labels each: ``row_id, labels``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    named = docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    all_of = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("quality:"), "quality"), F.concat(F.lit("toxic:"), "toxic"))
    return named.select(F.col("doc_id").alias("row_id"), F.array_sort(F.array_compact(all_of)).alias("labels"))


def texts(df: DataFrame, id_col: str, text_col: str, least: int = 50, most: int | None = None) -> DataFrame:
    """``row_id, text``: tidied, without the shortest, and whole unless ``most`` is given."""
    return df.select(F.col(id_col).alias("row_id"), clean_document(F.col(text_col), most).alias("text")).filter(F.length("text") >= least)


def _named(column: Column, names: dict[str, str]) -> Column:
    """``column`` by a stated map; what the map lacks stays as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[column], column) if names else column


def news_csv(spark: SparkSession, path: str, most_rows: int | None = None, most: int | None = None, classes: dict[int, str] | None = None, groups: dict[str, str] | None = None) -> DataFrame:
    """A headerless CSV of class, title and body: ``class, leaf, grp, text``.

    ``classes`` names the leaf of a class and ``groups`` the group of a leaf; both default to what they are given.
    """
    rows = spark.read.csv(path, schema="class int, title string, body string", quote='"', escape='"', multiLine=True)
    rows = rows if most_rows is None else rows.limit(most_rows)
    leaf = _named(F.col("class").cast("string"), {str(k): v for k, v in (classes or {}).items()})
    return rows.select("class", leaf.alias("leaf"), _named(leaf, groups or {}).alias("grp"), clean_document(F.concat_ws(". ", "title", "body"), most).alias("text"))


def newsgroups(posts: DataFrame, id_col: str, label_col: str, text_col: str, names: dict[str, str] | None = None, groups: dict[str, str] | None = None, least: int = 50, most: int | None = None) -> DataFrame:
    """``row_id, leaf, grp, text`` of posts whose label is a dotted name: the leaf by ``names``, the group by the label's first part and ``groups``."""
    labels = posts.select(F.col(id_col).alias("row_id"), _named(F.col(label_col), names or {}).alias("leaf"), _named(F.split(F.col(label_col), "[.]")[0], groups or {}).alias("grp"))
    return labels.join(texts(posts, id_col, text_col, least, most), "row_id")


def topic_hierarchy(docs: DataFrame, roots: dict[str, str], least: int = 1) -> tuple[DataFrame, DataFrame]:
    """``row_id, labels`` with the codes of at least ``least`` rows, and ``code, parent`` worked out anew for the codes that stay.

    ``docs``: ``row_id, labels``; ``roots``: letter to root code.
    """
    kept = frequent_labels(docs, least)
    return kept, parent_codes(kept.select(F.explode("labels").alias("code")).distinct(), roots)


def roots_of(edges: DataFrame) -> DataFrame:
    """``label, root``: the topmost ancestor of each label of a hierarchy ``label, parent``."""
    tops = edges.filter("parent IS NULL").select(F.col("label").alias("ancestor"))
    return descendants(edges).join(tops, "ancestor").select("label", F.col("ancestor").alias("root"))


def children_of(edges: DataFrame) -> DataFrame:
    """``label, children``: sorted; a label without any has an empty list."""
    told = edges.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("label")).agg(F.array_sort(F.collect_set("label")).alias("children"))
    return edges.select("label").distinct().join(told, "label", "left").select("label", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def synthetic(spark: SparkSession, n: int, groups: int = 3, leaves: int = 2, seed: int = 0) -> DataFrame:
    """Rows with leaves drawn by a seeded hash."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(groups * leaves))
    return spark.range(n).select(F.col("id").alias("row_id"), draw.alias("d")).select("row_id", F.concat(F.lit("g"), (F.col("d") / leaves).cast("int"), F.lit("_l"), F.col("d") % leaves).alias("leaf"), F.concat(F.lit("g"), (F.col("d") / leaves).cast("int")).alias("grp"))


def frequent_labels(rows: DataFrame, least: int) -> DataFrame:
    """``row_id, labels`` with labels of fewer rows left out."""
    each = rows.select("row_id", F.explode("labels").alias("label"))
    kept = each.groupBy("label").agg(F.countDistinct("row_id").alias("n")).filter(F.col("n") >= least).select("label")
    return each.join(kept, "label", "left_semi").groupBy("row_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def parent_codes(codes: DataFrame, roots: dict[str, str]) -> DataFrame:
    """``code, parent``: the longest kept code that it begins with, else the root of its letter; roots have none. ``codes`` is a label list."""
    kept = codes.select("code").distinct()
    longer = kept.alias("c").join(kept.alias("p"), F.col("c.code").startswith(F.col("p.code")) & (F.length("c.code") > F.length("p.code")) & ~F.col("p.code").isin(list(roots.values())), "left")
    near = longer.groupBy(F.col("c.code").alias("code")).agg(F.max_by(F.col("p.code"), F.length("p.code")).alias("near"))
    root = F.create_map(*[F.lit(x) for kv in roots.items() for x in kv])[F.substring("code", 1, 1)]
    return near.select("code", F.when(~F.col("code").isin(list(roots.values())), F.coalesce("near", root)).alias("parent"))


def descendants(edges: DataFrame) -> DataFrame:
    """``ancestor, label`` of a hierarchy ``label, parent``, itself included; cycles end."""
    edges.createOrReplaceTempView("prismview_hierarchy")
    return edges.sparkSession.sql("""
        WITH RECURSIVE down(ancestor, label, depth) AS (
            SELECT label, label, 0 FROM prismview_hierarchy
            UNION ALL
            SELECT d.ancestor, h.label, d.depth + 1 FROM down d JOIN prismview_hierarchy h ON h.parent = d.label WHERE d.depth < 32
        ) SELECT DISTINCT ancestor, label FROM down""")


def stratified_sample(rows: DataFrame, n: int, leaves: int, seed: int = 0) -> DataFrame:
    """An equal quota of each leaf, then at most ``n`` rows; may give fewer. ``rows``: ``row_id, leaf``."""
    quota = max(1, n // leaves)
    key = sample_key(seed, 0, "leaf", F.col("leaf"), F.col("row_id"))
    nth = F.row_number().over(Window.partitionBy("leaf").orderBy(key, "row_id"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= quota).drop("nth").orderBy(sample_key(seed, 0, "all", F.lit(""), F.col("row_id")), "row_id").limit(n)


def uniform_sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(sample_key(seed, 0, "uniform", F.lit(""), F.col("row_id")), "row_id").limit(n)


def load_corpus(spark: SparkSession, name: str, sf_dir: str, size: int | None = None, leaves: int = 25, seed: int = 0) -> DataFrame:
    """A corpus by name, cut to a stratified sample of ``size`` rows if that is given."""
    known = {
        "customers": lambda: customers(spark, sf_dir),
        "orders": lambda: orders(spark, sf_dir),
        "synthetic": lambda: synthetic(spark, size or 1000, seed=seed),
        "news": lambda: news_csv(spark, f"{sf_dir}/news.csv").withColumn("row_id", F.monotonically_increasing_id()),
        "documents": lambda: spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("row_id"), F.concat_ws(".", "lang", "source").alias("leaf"), F.col("lang").alias("grp"), "text"),
    }
    if name not in known:
        raise ValueError(f"unknown corpus {name!r}; known: {', '.join(sorted(known))}")
    rows = known[name]()
    return rows if size is None else stratified_sample(rows, size, leaves, seed)
