"""Scalar functions: strings, regular expressions, dates, numbers, arrays, maps, JSON, variants, URLs, CSV. All builtins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import table


@query("""select p_partkey, cast(length(p_name) as bigint) as len, lower(p_brand) as low, md5(p_name) as digest, replace(p_type, ' ', '_') as joined, reverse(p_brand) as back,
lpad(p_brand, 12, '*') as padded, string_split(p_type, ' ')[1] as first_word, p_brand || '/' || p_type as both, substr(p_name, 2, 4) as part_of from part""")
def fn_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.length("p_name").cast("long").alias("len"), F.lower("p_brand").alias("low"), F.md5("p_name").alias("digest"), F.replace(c("p_type"), F.lit(" "), F.lit("_")).alias("joined"), F.reverse("p_brand").alias("back"),
        F.lpad("p_brand", 12, "*").alias("padded"), F.split("p_type", " ")[0].alias("first_word"), F.concat(c("p_brand"), F.lit("/"), c("p_type")).alias("both"), F.substring("p_name", 2, 4).alias("part_of"),
    )


@query("select p_partkey, regexp_replace(p_name, '[0-9]+', '#', 'g') as masked, regexp_extract(p_brand, '([0-9]+)', 1) as digits from part")
def fn_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", "[0-9]+", "#").alias("masked"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"))


@query("select p_partkey, levenshtein(p_brand, p_type) as distance from part")
def fn_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_brand", "p_type").cast("long").alias("distance"))


@query("""with w as (select p_partkey, upper(split_part(p_name, ' ', 2)) as name from part),
t as (select *, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202') as c from w),
u as (select *, c[1] || replace(c[2:], '7', '') as d from t),
v as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') as e from u)
select p_partkey, rpad(name[1] || replace(e[2:], '0', '')[1:3], 4, '0') as code from v""")
def fn_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound of each part's noun."""
    return table(spark, sf_dir, "part").select("p_partkey", F.soundex(F.element_at(F.split("p_name", " "), 2)).alias("code"))


@query("select n_nationkey, md5(n_name) as md, sha1(n_name) as s1, sha256(n_name) as s2 from nation")
def fn_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.md5("n_name").alias("md"), F.sha1("n_name").alias("s1"), F.sha2("n_name", 256).alias("s2"))


@query("select o_orderkey, strftime(o_orderdate + interval 1 month + interval 10 day + interval 2 hour, '%Y-%m-%d %H:%M:%S') as due from orders")
def fn_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.col("o_orderdate") + F.make_interval(F.lit(0), F.lit(1), F.lit(0), F.lit(10), F.lit(2))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(later, "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')) as bigint) as words, cast(length(text) as bigint) as chars from documents")
def fn_text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.length("text").cast("long").alias("chars"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))), 6) as squared, round(cast(list_max(embedding) as double), 6) as most from embeddings")
def fn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    squared = F.aggregate(F.zip_with(v, v, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(squared, 6).alias("squared"), F.round(F.array_max(v), 6).alias("most"))


@query("""select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m, cast(dayofweek(o_orderdate) + 1 as bigint) as dow, cast(quarter(o_orderdate) as bigint) as q,
cast(date_diff('day', timestamp '1992-01-01', o_orderdate) as bigint) as days, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month_start, strftime(last_day(o_orderdate), '%Y-%m-%d') as month_end from orders""")
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.dayofweek(d).cast("long").alias("dow"), F.quarter(d).cast("long").alias("q"),
        F.datediff(d, F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.date_format(F.date_trunc("month", d), "yyyy-MM-dd").alias("month_start"), F.date_format(F.last_day(d), "yyyy-MM-dd").alias("month_end"),
    )


@query("""select l_orderkey, l_linenumber, cast(l_quantity as bigint) % 7 as m, round(sqrt(l_extendedprice), 6) as root, cast(ceil(l_tax * 100) as bigint) as up, abs(l_discount - 0.05) as off, round(ln(l_quantity), 8) as l,
case when l_discount = 0 then null else round(l_tax / l_discount, 6) end as ratio from lineitem""")
def fn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_quantity").cast("long") % 7).alias("m"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"), F.ceil(c("l_tax") * 100).alias("up"), F.abs(c("l_discount") - 0.05).alias("off"), F.round(F.log(c("l_quantity")), 8).alias("l"),
        F.round(F.try_divide(c("l_tax"), c("l_discount")), 6).alias("ratio"),
    )


@query("""select c_custkey, list_sum(list_transform(range(1, cast(c_custkey % 6 + 2 as bigint)), lambda x: x * x)) as squares, len(list_filter(range(0, 10), lambda x: x % (c_custkey % 3 + 1) = 0)) as kept,
array_to_string(list_sort(string_split(c_mktsegment, 'E')), '+') as parts from customer""")
def fn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    squares = F.aggregate(F.transform(F.sequence(F.lit(1).cast("long"), k % 6 + 1), lambda x: x * x), F.lit(0).cast("long"), lambda a, x: a + x)
    kept = F.size(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda x: x % (k % 3 + 1) == 0)).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", squares.alias("squares"), kept.alias("kept"), F.array_join(F.array_sort(F.split("c_mktsegment", "E")), "+").alias("parts"))


@query("select n_nationkey, n_regionkey * 2 as doubled, cast(2 as bigint) as entries from nation")
def fn_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.map_from_arrays(F.array(F.lit("key"), F.lit("twice")), F.array(F.col("n_nationkey"), F.col("n_regionkey") * 2))
    rows = table(spark, sf_dir, "nation").withColumn("m", pairs)
    positive = F.map_filter("m", lambda k, v: v >= 0)
    return rows.select("n_nationkey", F.element_at("m", "twice").alias("doubled"), F.size(positive).cast("long").alias("entries"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(json_extract_string(props, '$.none') as bigint) as missing from events")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint, none bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.get_json_object("props", "$.none").cast("long").alias("missing"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def fn_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("select n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' as doc from nation")
def fn_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("doc"))


@query("select n_nationkey, 'h' || n_regionkey || '.example' as host, '/n' as path, 'v' || n_nationkey as v from nation")
def fn_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.format_string("https://h%d.example/n?q=v%d", "n_regionkey", "n_nationkey")
    rows = table(spark, sf_dir, "nation").withColumn("u", url)
    part = lambda p, *k: F.parse_url(F.col("u"), F.lit(p), *map(F.lit, k))
    return rows.select("n_nationkey", part("HOST").alias("host"), part("PATH").alias("path"), F.url_decode(part("QUERY", "q")).alias("v"))


@query("select n_nationkey, n_regionkey as r, n_name as name from nation")
def fn_csv_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.to_csv(F.struct("n_regionkey", "n_name")).alias("line"), F.concat(F.lit("<r><n>"), F.col("n_name"), F.lit("</n></r>")).alias("doc"))
    return rows.select("n_nationkey", F.from_csv("line", "r int, name string")["r"].alias("r"), F.from_xml("doc", "n string")["n"].alias("name"))


@query("select s_suppkey, s_nationkey & 7 as low_bits, s_nationkey << 2 as shifted, xor(s_nationkey, 5) as x from supplier")
def fn_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", k.bitwiseAND(7).alias("low_bits"), F.shiftleft(k, 2).alias("shifted"), k.bitwiseXOR(F.lit(5)).alias("x"))
