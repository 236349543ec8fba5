"""Queries: filters and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import domain
from larder.operators import filters as op
from larder.plans.registry import query, table

DOMAIN_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '')"
RECORD_SQL = "documents LEFT JOIN labels USING (doc_id)"
PLACEHOLDERS = ["placeholder", "no-image", "spam-farm", "default"]
BLOCKED = ["cheap-pills.example.com", "spam-farm.example.org", "example.net"]


def records(spark, d):
    """Documents with their labels where there are any: records with missing fields."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


def sites(spark, names, column="site"):
    return spark.createDataFrame([(x,) for x in names], f"{column} string")


@query("flt_required_fields", f"SELECT doc_id, lang, quality, toxic FROM {RECORD_SQL} WHERE trim(text) <> '' AND quality IS NOT NULL AND toxic IS NOT NULL AND trim(lang) <> ''")
def flt_required_fields(spark, d):
    return op.required_fields(records(spark, d), ["text", "lang", "quality", "toxic"]).select("doc_id", "lang", "quality", "toxic")


@query("flt_numeric_range", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice BETWEEN 0 AND 950")
def flt_numeric_range(spark, d):
    return op.numeric_range(table(spark, d, "part"), {"p_size": (5, 30), "p_retailprice": (0, 950)}).select("p_partkey", "p_size", "p_retailprice")


@query("flt_contains_any", "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%bolt%' OR lower(p_name) LIKE '%hot%' OR lower(p_type) LIKE '%promo%'")
def flt_contains_any(spark, d):
    return op.contains_any(table(spark, d, "part"), {"p_name": ["Bolt", "hot"], "p_type": ["promo"]}).select("p_partkey", "p_name", "p_type")


@query("flt_multivalue_contains", "SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda x: x LIKE '%ring%' OR x LIKE '%ed%')) > 0")
def flt_multivalue_contains(spark, d):
    return op.multivalue_contains(table(spark, d, "part"), "p_name", ["ring", "ed"]).select("p_partkey", "p_name")


@query("flt_url_placeholder", "SELECT page_id, url FROM pages WHERE trim(url) <> '' AND NOT regexp_matches(lower(url), 'placeholder|no-image|spam-farm|default')")
def flt_url_placeholder(spark, d):
    return op.without_placeholders(table(spark, d, "pages"), "url", PLACEHOLDERS).select("page_id", "url")


@query(
    "flt_blocked_domain",
    f"""
WITH p AS (SELECT page_id, {DOMAIN_SQL} AS domain FROM pages), b(site) AS (VALUES ('cheap-pills.example.com'), ('spam-farm.example.org'), ('example.net'))
SELECT page_id, domain FROM p WHERE domain <> '' AND page_id NOT IN (SELECT page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 7 = 0))
  AND NOT EXISTS (SELECT 1 FROM b WHERE p.domain = b.site OR ends_with(p.domain, '.' || b.site))""",
)
def flt_blocked_domain(spark, d):
    return op.unblocked(table(spark, d, "pages"), "url", sites(spark, BLOCKED), table(spark, d, "pages").filter("page_id % 7 = 0").select("url")).select("page_id", "domain")


def image_list():
    return F.when(F.col("page_id") % 3 != 0, F.transform(F.sequence(F.lit(1), (F.col("page_id") % 3).cast("int")), lambda i: F.concat(F.col("url"), F.lit("/img"), i.cast("string"))))


def image_scalar():
    return F.when(F.col("page_id") % 2 == 0, F.col("url"))


IMAGES_SQL = "CASE WHEN page_id % 3 <> 0 THEN list_transform(range(1, (page_id % 3)::BIGINT + 1), lambda i: url || '/img' || i::VARCHAR) END"
SCALAR_SQL = "CASE WHEN page_id % 2 = 0 THEN url END"


def pages_with_images(spark, d):
    return table(spark, d, "pages").select("page_id", "url", image_list().alias("images"), image_scalar().alias("image_url"))


@query("flt_has_image", f"SELECT page_id, url FROM (SELECT page_id, url, {IMAGES_SQL} AS images, {SCALAR_SQL} AS image_url FROM pages) WHERE coalesce(len(images), 0) > 0 OR image_url <> ''")
def flt_has_image(spark, d):
    return op.with_image(pages_with_images(spark, d), "images", "image_url").select("page_id", "url")


@query(
    "flt_by_id",
    """
WITH w AS (SELECT DISTINCT l_partkey * 7 AS o_orderkey FROM lineitem WHERE l_quantity = 1)
SELECT w.o_orderkey, o.o_orderkey IS NOT NULL AS found, o.o_totalprice FROM w LEFT JOIN orders o USING (o_orderkey)""",
)
def flt_by_id(spark, d):
    wanted = table(spark, d, "lineitem").filter("l_quantity = 1").select((F.col("l_partkey") * 7).alias("o_orderkey")).distinct()
    found, missing = op.by_id(table(spark, d, "orders"), wanted, "o_orderkey")
    return found.select("o_orderkey", F.lit(True).alias("found"), "o_totalprice").unionByName(missing.select("o_orderkey", F.lit(False).alias("found"), F.lit(None).cast("double").alias("o_totalprice")))


@query(
    "prj_coalesce_first_valid",
    """
SELECT c_custkey, coalesce(CASE WHEN lower(trim(c_mktsegment)) NOT IN ('building', 'machinery') AND trim(c_mktsegment) <> '' THEN trim(c_mktsegment) END,
  CASE WHEN trim(c_name) <> '' AND lower(trim(c_name)) NOT IN ('building', 'machinery') THEN trim(c_name) END) AS label FROM customer""",
)
def prj_coalesce_first_valid(spark, d):
    return table(spark, d, "customer").select("c_custkey", op.coalesce_first_valid(["c_mktsegment", "c_name"], ["BUILDING", "MACHINERY"]).alias("label"))


@query(
    "prj_image_array",
    f"""
WITH p AS (SELECT page_id, {IMAGES_SQL} AS images, {SCALAR_SQL} AS image_url FROM pages)
SELECT page_id, coalesce(len(images), 0)::INTEGER AS n_images, coalesce(images[1], image_url) AS main_url,
       array_to_string(list_transform(images, lambda x, i: (CASE WHEN i = 1 THEN 'main' ELSE 'gallery' END) || '=' || x), ';') AS shown FROM p""",
)
def prj_image_array(spark, d):
    p = pages_with_images(spark, d).withColumn("array", op.image_array("images"))
    return p.select("page_id", F.coalesce(F.size("array"), F.lit(0)).alias("n_images"), op.main_image(F.col("array"), F.col("image_url")).alias("main_url"), F.array_join(F.transform("array", lambda x: F.concat(x["type"], F.lit("="), x["url"])), ";").alias("shown"))


@query(
    "prj_product_record",
    "SELECT substring(trim(p_name), 1, 6) AS product_name, substring(trim(p_brand), 1, 7) AS brand, p_retailprice AS calories_100g, p_size AS additives_n, p_type IN ('PROMO', 'SMALL') AS no_nutriments, p_partkey::VARCHAR AS off_code FROM part",
)
def prj_product_record(spark, d):
    return op.product_record(
        table(spark, d, "part"), {"off_code": ("p_partkey", 50), "product_name": ("p_name", 6), "brand": ("p_brand", 7)}, {"calories_100g": "p_retailprice"}, {"additives_n": "p_size"}, {"no_nutriments": F.col("p_type").isin("PROMO", "SMALL")}
    )


RAW_UNITS = ["Cups", " tbsp", "g", "slices", "piece", "oz.", "Pinch"]


@query(
    "prj_standard_recipe",
    """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER AS q,
    (['cup', 'tablespoon', 'gram', 'slice', 'piece', 'ounce', 'pinch'])[l_linenumber] AS unit FROM lineitem),
n AS (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN (q + 2)::VARCHAR WHEN 1 THEN '0.5' WHEN 2 THEN (q + 0.25)::VARCHAR WHEN 3 THEN q::VARCHAR ELSE 'to taste' END AS quantity FROM l),
i AS (SELECT l_orderkey, string_agg(quantity || ' ' || unit || ' part ' || l_partkey::VARCHAR, ';' ORDER BY l_linenumber, l_partkey, q) AS ingredients FROM n GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'recipe ' || o_orderkey::VARCHAR ELSE '' END AS title, 'orders' AS parser_method, CASE WHEN o_orderkey % 4 = 0 THEN 'Dinner' ELSE 'Other' END AS meal_occasion,
  '' AS total_time, coalesce(ingredients, '') AS ingredients, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS n_steps,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '' END AS calories, '' AS protein, '' AS image, 'https://example.com/' || o_orderkey::VARCHAR AS source_url FROM orders LEFT JOIN i ON l_orderkey = o_orderkey""",
)
def prj_standard_recipe(spark, d):
    k, q, line = F.col("o_orderkey"), F.col("l_quantity").cast("int"), F.col("l_linenumber")
    written = F.when(line % 5 == 0, F.concat_ws(" - ", q, q + 2)).when(line % 5 == 1, "1/2").when(line % 5 == 2, F.concat_ws(" ", q, F.lit("1/4"))).when(line % 5 == 3, q.cast("string")).otherwise(" to taste ")
    one = F.struct(F.concat(F.lit("part "), F.col("l_partkey")).alias("name"), written.alias("quantity"), F.get(F.array(*[F.lit(u) for u in RAW_UNITS]), line - 1).alias("unit"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(line, "l_partkey", q.alias("q"), one.alias("one")))).alias("lines"))
    facts = F.when(k % 2 == 0, F.struct(F.col("o_custkey").cast("string").alias("calories"), *[F.lit(None).cast("string").alias(c) for c in ("fat", "carbs", "protein")]))
    recipe = op.standard_record(
        F.when(k % 3 > 0, F.concat(F.lit("recipe "), k)),
        F.lit("orders"),
        F.transform("lines", lambda x: x["one"]),
        F.when(k % 5 == 0, F.array(F.lit("Mix."), F.lit("Bake."))),
        F.concat(F.lit("https://example.com/"), k),
        nutrition=facts,
        meal_occasion=F.when(k % 4 == 0, "Dinner"),
    )
    r = table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", recipe.alias("r"))
    shown = F.array_join(F.transform("r.ingredients", lambda x: F.concat_ws(" ", x["quantity"], x["unit"], x["name"])), ";")
    return r.select("o_orderkey", "r.title", "r.parser_method", "r.meal_occasion", "r.total_time", shown.alias("ingredients"), F.size("r.directions").alias("n_steps"), "r.nutrition.calories", "r.nutrition.protein", "r.image", "r.source_url")


@query(
    "prj_app_view",
    """
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT o_custkey AS query_id, o_orderkey, o_totalprice, coalesce(n, 0) AS n, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS note FROM orders LEFT JOIN c ON o_orderkey = l_orderkey)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o_totalprice DESC, o_orderkey) AS display_position, o_orderkey, n < 4 AS closest_match,
  '{"id":' || o_orderkey::VARCHAR || ',"ingredients":' || n::VARCHAR || (CASE WHEN note IS NULL THEN '' ELSE ',"note":"' || note || '"' END) || '}' AS payload FROM r""",
)
def prj_app_view(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    position = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    payload = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("n").alias("ingredients"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("note")))
    return o.select(F.col("o_custkey").alias("query_id"), position.alias("display_position"), "o_orderkey", (F.col("n") < 4).alias("closest_match"), payload.alias("payload"))


@query(
    "prj_minimal_view",
    """
SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)[1:8], ',') AS ingredients,
  count(*) FILTER (l_returnflag = 'N') AS exact_count, count(*) FILTER (l_returnflag <> 'N') AS closest_count FROM lineitem GROUP BY 1""",
)
def prj_minimal_view(spark, d):
    lines = table(spark, d, "lineitem")
    view = op.minimal_view(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_partkey", F.col("l_returnflag") == "N")
    return view.withColumn("ingredients", F.array_join(F.col("ingredients").cast("array<string>"), ","))


STORE_UNIT = "CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'cup' WHEN 2 THEN 'count' END"


@query(
    "prj_cart_eligible",
    f"SELECT l_orderkey, l_partkey, l_linenumber, l_quantity > 3 AND coalesce({STORE_UNIT}, '') <> '' AND p_name <> '' AND l_returnflag <> 'R' AND NOT (l_linestatus = 'F' AND l_discount > 0.05) AS cart_friendly FROM lineitem JOIN part ON p_partkey = l_partkey",
)
def prj_cart_eligible(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    quantity = F.when(F.col("l_quantity") > 3, F.col("l_quantity")).when(F.col("l_quantity") > 1, 0.0)
    optional = F.when(F.col("l_discount") > 0.05, F.col("l_linestatus") == "F")
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", op.cart_eligible(quantity, F.expr(STORE_UNIT), F.col("p_name"), F.col("l_returnflag") == "R", optional).alias("cart_friendly"))


@query("prj_url_domain", f"SELECT page_id, {DOMAIN_SQL} AS domain FROM pages")
def prj_url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", domain("url").alias("domain"))
