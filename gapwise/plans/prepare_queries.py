"""Queries: projection, filter, profile, sampling and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapwise.operators import encode, filters, profile, project, rows, sample
from gapwise.plans import fixtures as fx
from gapwise.plans.registry import load, query

# ---------------------------------------------------------------- projection


@query("prj_xy", "SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice FROM part")
def prj_xy(spark, folder):
    part = load(spark, folder, "part").select(
        "p_partkey", F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice")
    x, y = project.features_and_label(part, "p_retailprice", "p_partkey")
    return rows.align(x, y, "p_partkey").select("p_partkey", "p_size", "p_retailprice")


@query("prj_rename", "SELECT p_partkey AS feature_0, p_size::DOUBLE AS feature_1, "
                     "p_retailprice AS label FROM part")
def prj_rename(spark, folder):
    part = load(spark, folder, "part").select(
        "p_partkey", F.col("p_size").cast("double"), "p_retailprice")
    return project.rename_positional(part)


@query("prj_move_label", "SELECT o_custkey, o_totalprice, o_orderpriority, o_orderstatus "
                         "FROM orders")
def prj_move_label(spark, folder):
    orders = load(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice", "o_orderpriority")
    return project.move_label_last(orders, "o_orderstatus")


@query("prj_label_recode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE "
                           "WHEN 'O' THEN (-1.0)::DOUBLE END AS label FROM orders")
def prj_label_recode(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return project.recode_label(orders, "o_orderstatus", {"F": 1, "O": -1},
                                "label").select("o_orderkey", "label")


def _binarised(table, column, key, situation):
    def run(spark, folder):
        df = load(spark, folder, table).select(key, column)
        return project.binarise_label(df, column, situation, name="label").select(
            key, F.col("label").cast("bigint").alias("label"))
    return run


for _name, _table, _key, _column, _situation, _sql in [
    ("prj_binarise_mean", "orders", "o_orderkey", "o_totalprice", "mean",
     "(o_totalprice > (SELECT avg(o_totalprice) FROM orders))"),
    ("prj_binarise_median", "orders", "o_orderkey", "o_totalprice", "median",
     "(o_totalprice > (SELECT median(o_totalprice) FROM orders))"),
    ("prj_binarise_mode", "part", "p_partkey", "p_size", "mode",
     "(p_size = (SELECT p_size FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size "
     "LIMIT 1))"),
]:
    query(_name, f"SELECT {_key}, CASE WHEN {_sql} THEN 1 ELSE 0 END::BIGINT AS label "
                 f"FROM {_table}")(_binarised(_table, _column, _key, _situation))


@query("prj_to_numeric", f"WITH {fx.TEXT} SELECT p_partkey, size_text::DOUBLE AS size_text, "
                         "mixed, p_type FROM sm")
def prj_to_numeric(spark, folder):
    return project.to_numeric(fx.text_gaps(spark, folder)).select(
        "p_partkey", "size_text", "mixed", "p_type")


@query("prj_try_parse", f"WITH {fx.TEXT} SELECT p_partkey, "
                        "coalesce(TRY_CAST(mixed AS DOUBLE), 0) AS mixed, CASE WHEN size_text "
                        "IS NOT NULL THEN coalesce(TRY_CAST(size_text AS DOUBLE), 0) END "
                        "AS size_text FROM sm")
def prj_try_parse(spark, folder):
    df = fx.text_gaps(spark, folder).select("p_partkey", "mixed", "size_text")
    return project.try_parse(project.try_parse(df, "mixed"), "size_text")


@query("prj_drop_categorical", f"WITH {fx.TEXT} SELECT p_partkey, size_text::DOUBLE AS "
                               "size_text, p_size::BIGINT AS p_size FROM sm")
def prj_drop_categorical(spark, folder):
    df = fx.text_gaps(spark, folder)
    return project.drop_categorical(df).withColumn("p_size", F.col("p_size").cast("bigint"))


@query("prj_mode_binarise", f"""WITH {fx.TEXT}, m AS (SELECT p_type AS v FROM sm
  WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1)
  SELECT p_partkey, CASE WHEN p_type IS NOT NULL THEN
  CASE WHEN p_type = (SELECT v FROM m) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS p_type
  FROM sm""")
def prj_mode_binarise(spark, folder):
    df = fx.text_gaps(spark, folder).select("p_partkey", "p_type")
    return encode.mode_binarise(df, ["p_type"])


# p_brand and mixed have more than 20 distinct values, p_type fewer
@query("prj_drop_high_card", f"WITH {fx.TEXT} SELECT p_partkey, p_type FROM sm")
def prj_drop_high_card(spark, folder):
    df = fx.text_gaps(spark, folder).select("p_partkey", "p_type", "mixed", "p_brand")
    return encode.drop_high_cardinality(df)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_ONEHOT = ", ".join(
    f"CASE WHEN p IS NOT NULL THEN CASE WHEN p = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
    f"END AS \"o_orderpriority_{v}\"" for v in _PRIORITIES)


@query("prj_onehot_null", f"SELECT o_orderkey, {_ONEHOT} FROM (SELECT o_orderkey, CASE WHEN "
       f"{fx.sql_uniform('prio', 'o_orderkey')} >= 0.05 THEN o_orderpriority END AS p "
       "FROM orders)")
def prj_onehot_null(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    df = sample.blank_at_rate(df, ["o_orderkey"], "o_orderpriority", 0.05, "prio")
    return encode.onehot_with_nulls(df, ["o_orderpriority"])


_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("prj_complete_cols", f"WITH {fx.LINE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) = count(*) AS is_complete FROM lm"
    for c in _LINE_COLUMNS))
def prj_complete_cols(spark, folder):
    return profile.column_completeness(fx.line_gaps(spark, folder), _LINE_COLUMNS)


@query("prj_single_value", f"WITH {fx.LINE}, s AS (SELECT l_quantity, l_tax, CASE WHEN l_tax "
       "IS NOT NULL THEN 1 END AS tax_known, 7 AS fixed FROM lm), c AS (" + " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM s"
           for c in ["l_quantity", "l_tax", "tax_known", "fixed"])
       + ") SELECT \"column\" FROM c WHERE n = 1")
def prj_single_value(spark, folder):
    df = fx.line_gaps(spark, folder).select(
        "l_quantity", "l_tax", F.when(F.col("l_tax").isNotNull(), 1).alias("tax_known"),
        F.lit(7).alias("fixed"))
    return profile.single_valued_columns(df, df.columns)


@query("prj_split_columns", f"WITH {fx.LINE} SELECT 'complete' AS part, count(*) AS n_rows, "
       "3::BIGINT AS n_columns FROM lm UNION ALL SELECT 'incomplete', count(*), 1 FROM lm")
def prj_split_columns(spark, folder):
    df = fx.line_gaps(spark, folder).withColumn(
        "id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    complete, gaps = project.split_complete_columns(df, _LINE_COLUMNS, "id")
    return rows.stack_rows(*[
        part.agg(F.lit(name).alias("part"), F.count("*").alias("n_rows"),
                 F.lit(len(part.columns) - 1).cast("bigint").alias("n_columns"))
        for name, part in (("complete", complete), ("incomplete", gaps))])


# -------------------------------------------------------------------- filter

_KEPT = "l_orderkey, l_linenumber, l_quantity, l_discount, l_tax"


@query("fil_drop_any", f"WITH {fx.LINE_TWO} SELECT {_KEPT} FROM lm "
                       "WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL")
def fil_drop_any(spark, folder):
    df = fx.line_gaps(spark, folder, discount=True).select(*_KEPT.split(", "))
    return filters.drop_incomplete(df)


@query("fil_drop_all", f"WITH {fx.LINE_TWO} SELECT {_KEPT} FROM lm "
                       "WHERE l_discount IS NOT NULL OR l_tax IS NOT NULL")
def fil_drop_all(spark, folder):
    df = fx.line_gaps(spark, folder, discount=True).select(*_KEPT.split(", "))
    return filters.drop_all_null(df, ["l_discount", "l_tax"])


@query("fil_drop_label_null", f"WITH {fx.DOCS} SELECT doc_id, lang, n_chars, "
                              "quality::BIGINT AS quality FROM dl WHERE quality IS NOT NULL")
def fil_drop_label_null(spark, folder):
    df = fx.document_labels(spark, folder)
    return filters.drop_unlabelled(df, "quality").select(
        "doc_id", "lang", "n_chars", F.col("quality").cast("bigint").alias("quality"))


@query("fil_row_split", f"WITH {fx.LINE_TWO} SELECT CASE WHEN l_discount IS NULL OR l_tax IS "
       "NULL THEN 'incomplete' ELSE 'complete' END AS part, count(*) AS n_rows, "
       "round(avg(l_quantity), 6) AS avg_quantity FROM lm GROUP BY 1")
def fil_row_split(spark, folder):
    df = fx.line_gaps(spark, folder, discount=True)
    complete, gaps = filters.split_rows(df, ["l_discount", "l_tax"])
    return rows.stack_rows(*[
        part.agg(F.lit(name).alias("part"), F.count("*").alias("n_rows"),
                 F.round(F.avg("l_quantity"), 6).alias("avg_quantity"))
        for name, part in (("complete", complete), ("incomplete", gaps))])


# ------------------------------------------------------------------- profile

@query("prf_missing_table", f"WITH {fx.LINE_TWO}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS n FROM lm"
    for c in _LINE_COLUMNS) + ") SELECT \"column\", n_missing, "
    "round(100.0::DOUBLE * n_missing / n, 1) AS pct_missing, 'double' AS dtype "
    "FROM c WHERE n_missing > 0")
def prf_missing_table(spark, folder):
    return profile.missing_table(fx.line_gaps(spark, folder, discount=True))


@query("prf_missing_factor", f"WITH {fx.LINE_TWO}, r AS (SELECT CASE WHEN l_discount IS NULL "
       "OR l_tax IS NULL THEN 1 ELSE 0 END AS hit FROM lm) SELECT sum(hit)::BIGINT AS "
       "n_incomplete, round(avg(hit), 6) AS factor FROM r")
def prf_missing_factor(spark, folder):
    return profile.missing_factor(fx.line_gaps(spark, folder, discount=True),
                                  _LINE_COLUMNS).withColumn("factor", F.round("factor", 6))


@query("prf_incomplete_cols", f"WITH {fx.LINE_TWO}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM lm"
    for c in _LINE_COLUMNS) + ") SELECT * FROM c WHERE n_missing > 0")
def prf_incomplete_cols(spark, folder):
    return profile.incomplete_column_table(fx.line_gaps(spark, folder, discount=True),
                                           _LINE_COLUMNS)


@query("prf_bounds", f"WITH {fx.LINE_TWO}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS gap, min({c}) + 0.0 AS min_value, "
    f"max({c}) + 0.0 AS max_value FROM lm" for c in _LINE_COLUMNS)
    + ") SELECT \"column\", min_value, max_value FROM c WHERE gap > 0")
def prf_bounds(spark, folder):
    return profile.bounds_table(fx.line_gaps(spark, folder, discount=True), _LINE_COLUMNS)


@query("prf_label_card", f"WITH {fx.DOCS}, g AS (SELECT quality FROM dl GROUP BY quality) "
       "SELECT count(quality) AS n_distinct, count(*) AS n_distinct_with_null FROM g")
def prf_label_card(spark, folder):
    return profile.label_cardinality(fx.document_labels(spark, folder), "quality")


# ---------------------------------------------------------- rows and sampling

@query("row_dense_id", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS dense_id, "
                       "o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def row_dense_id(spark, folder):
    kept = load(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    return rows.dense_ids(kept.select("o_orderkey"), "o_orderkey")


@query("row_align_join", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders "
                         "WHERE o_orderstatus <> 'P'")
def row_align_join(spark, folder):
    orders = load(spark, folder, "orders")
    x = orders.filter(F.col("o_orderstatus") != "P").select("o_orderkey", "o_orderstatus")
    return rows.align(x, orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


def _ranked(seed: str) -> str:
    return (f"row_number() OVER (ORDER BY {fx.sql_rank(seed, 'o_orderkey')}, o_orderkey)")


@query("spl_train_test", f"SELECT o_orderkey, {_ranked('42')} <= ceil(0.2::DOUBLE * "
                         "(SELECT count(*) FROM orders)) AS is_test FROM orders")
def spl_train_test(spark, folder):
    return sample.train_test_flag(load(spark, folder, "orders").select("o_orderkey"),
                                  "o_orderkey", 42)


@query("spl_train_test_hash", f"SELECT o_orderkey, {fx.sql_uniform('42', 'o_orderkey')} < 0.2 "
                              "AS is_test FROM orders")
def spl_train_test_hash(spark, folder):
    return sample.hash_split_flag(load(spark, folder, "orders").select("o_orderkey"),
                                  "o_orderkey", 42)


@query("smp_without_repl", f"SELECT o_orderkey, o_totalprice FROM (SELECT *, {_ranked('swr')} "
                           "AS nth FROM orders) WHERE nth <= 500")
def smp_without_repl(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sample.sample_rows(df, "o_orderkey", "swr", 500)


@query("smp_with_repl", f"""WITH d AS (SELECT floor({fx.sql_uniform('rep', "'draw'", 'j')}
  * (SELECT count(*) FROM orders)) AS position FROM range(50) r(j)),
  m AS (SELECT row_number() OVER (ORDER BY position) AS nth, n_draws FROM
    (SELECT position, count(*) AS n_draws FROM d GROUP BY position)),
  o AS (SELECT o_orderkey, {_ranked('rep')} AS nth FROM orders)
  SELECT o_orderkey, n_draws FROM o JOIN m USING (nth)""")
def smp_with_repl(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey")
    return sample.sample_with_replacement(df, "o_orderkey", "rep", 50)


_DIRTY = sample.pick_column(["size", "price"], "dirt")
_DIRTY_HIT = (f"row_number() OVER (ORDER BY {fx.sql_rank('dirt', 'p_partkey')}, p_partkey) "
              "<= floor(0.05::DOUBLE * count(*) OVER ())")


@query("cor_make_dirty", "SELECT p_partkey, " + ", ".join(
    f"CASE WHEN NOT hit THEN {c} END AS {c}" if c == _DIRTY else c for c in ["size", "price"])
    + f" FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price, {_DIRTY_HIT} "
      "AS hit FROM part)")
def cor_make_dirty(spark, folder):
    df = load(spark, folder, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"))
    return sample.make_dirty(df, "p_partkey", ["size", "price"], 0.05, "dirt")


# ------------------------------------------------------------- set operators

def _order_parts(spark, folder):
    df = fx.order_gaps(spark, folder)
    return filters.split_rows(df, ["total", "urgency"])


@query("set_except", f"WITH {fx.ORDERS} SELECT o_orderkey FROM og "
                     "WHERE total IS NOT NULL AND urgency IS NOT NULL")
def set_except(spark, folder):
    everything = load(spark, folder, "orders").select("o_orderkey")
    return rows.ids_except(everything, _order_parts(spark, folder)[1], "o_orderkey")


@query("set_semi", f"WITH {fx.ORDERS} SELECT o_orderkey FROM og "
                   "WHERE total IS NULL OR urgency IS NULL")
def set_semi(spark, folder):
    everything = load(spark, folder, "orders").select("o_orderkey")
    return rows.ids_in(everything, _order_parts(spark, folder)[1], "o_orderkey")


@query("set_union", f"WITH {fx.ORDERS} SELECT o_orderkey, CASE WHEN total IS NULL OR urgency "
                    "IS NULL THEN 'dirty' ELSE 'clean' END AS source FROM og")
def set_union(spark, folder):
    clean, dirty = _order_parts(spark, folder)
    return rows.stack_rows(clean.select("o_orderkey", F.lit("clean").alias("source")),
                           dirty.select("o_orderkey", F.lit("dirty").alias("source")))


@query("set_distinct_null_cols", f"WITH {fx.LINE_TWO} " + " UNION ".join(
    f"SELECT '{c}' AS \"column\" FROM lm WHERE {c} IS NULL" for c in _LINE_COLUMNS))
def set_distinct_null_cols(spark, folder):
    return profile.null_cell_columns(fx.line_gaps(spark, folder, discount=True), _LINE_COLUMNS)


