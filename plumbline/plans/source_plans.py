"""Record files: tables are written out in each format that the readers know, and read back through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.sources import files
from plumbline.storage import scratch_path, spread, table

CUSTOMER = StructType([StructField("c_custkey", LongType()), StructField("c_name", StringType()), StructField("c_mktsegment", StringType())])


def _lines(rows: DataFrame, line: Column, label: str) -> str:
    """The folder of a text file of one line a row."""
    path = scratch_path(rows.sparkSession, label)
    rows.select(line.alias("value")).write.text(path)
    return path


def _customers(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


def _json(broken: Column | None = None) -> Column:
    whole = F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment"))
    return whole if broken is None else F.when(broken, F.substring(whole, 1, 20)).otherwise(whole)


def records_strict(spark, sf_dir: str) -> DataFrame:
    return files.jsonl(spark, _lines(_customers(spark, sf_dir), _json(), "strict"), CUSTOMER)


def records_tolerant(spark, sf_dir: str) -> DataFrame:
    """Every tenth line is cut short and dropped, as are records without a key."""
    rows = _customers(spark, sf_dir).withColumn("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")))
    path = _lines(rows, _json(F.col("c_custkey") % 10 == 0), "tolerant")
    return files.jsonl(spark, path, CUSTOMER, "DROPMALFORMED").where("c_custkey is not null")


def records_bad_lines(spark, sf_dir: str) -> DataFrame:
    good, bad = files.jsonl_counting_bad(spark, _lines(_customers(spark, sf_dir), _json(F.col("c_custkey") % 10 == 0), "bad"), CUSTOMER)
    return good.agg(F.count("*").alias("good_lines")).crossJoin(bad)  # one row each


def records_with_separators(spark, sf_dir: str) -> DataFrame:
    """Separators of Unicode inside a record end no line."""
    rows = _customers(spark, sf_dir).withColumn("c_name", F.concat("c_name", F.lit("\u2028x\u0085y\u2029")))
    back = files.jsonl(spark, _lines(rows, _json(), "separators"), CUSTOMER)
    return back.select("c_custkey", F.length("c_name").cast("long").alias("chars"))


def records_any_format(spark, sf_dir: str) -> DataFrame:
    """The same records as lines and as one array are read alike."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    schema = StructType([StructField("n_nationkey", LongType()), StructField("n_name", StringType())])
    lines = _lines(nation, F.to_json(F.struct("n_nationkey", "n_name")), "lines")
    # The nations of the world: an array of a few records.
    array = _lines(nation.agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("xs")), F.to_json("xs"), "array")
    both = files.json_any(spark, lines, schema).withColumn("format", F.lit("lines"))
    return both.unionByName(files.json_any(spark, array, schema).withColumn("format", F.lit("array")))


def prompts_checked(spark, sf_dir: str) -> DataFrame:
    """Prompts of parts: every ninth has no text, every eleventh an unknown split, every thirteenth the id of part 1."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.when(key % 13 == 0, 1).otherwise(key).cast("string").alias("id"), F.when(key % 9 != 0, F.col("p_name")).alias("text"), F.lit("en").alias("language"),
        F.lit("us").alias("market"), F.lit("buy").alias("canonical_intent"), F.when(key % 11 == 0, "train").otherwise("dev").alias("split"), F.concat("p_brand", F.lit("|"), "p_type", F.lit("|")).alias("candidates"),
    )
    path = scratch_path(spark, "prompts")
    rows.write.option("header", True).csv(path)
    return files.prompts_csv(spark, path).groupBy("problem").agg(F.count("*").alias("n"), F.sum(F.size("candidates")).alias("candidates"))


def stores_in_use(spark, sf_dir: str) -> DataFrame:
    use = F.when(F.col("s_suppkey") % 3 == 0, " YES ").when(F.col("s_suppkey") % 3 == 1, "no")
    path = scratch_path(spark, "stores")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("domain"), "s_name", use.alias("use")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.stores_csv(spark, path).select(F.col("domain").cast("long").alias("s_suppkey"), "s_name")


def _quads(spark, sf_dir: str) -> DataFrame:
    """Four statements a part: its type, its name with escapes, its offer, and the offer's type; and a line that is none."""
    node, page = F.concat(F.lit("_:n"), "p_partkey"), F.concat(F.lit("<http://shop.example/"), "p_partkey", F.lit(">"))
    kind = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    lines = F.array(
        F.concat(node, F.lit(f" {kind} <http://schema.org/Product> "), page, F.lit(" .")),
        F.concat(node, F.lit(' <http://schema.org/name> "a \\"'), "p_name", F.lit('\\" \\u00e9"@en '), page, F.lit(" .")),
        F.concat(node, F.lit(" <http://schema.org/offers> _:o"), "p_partkey", F.lit(" "), page, F.lit(" .")),
        F.concat(F.lit("_:o"), "p_partkey", F.lit(f" {kind} <http://schema.org/Product> "), page, F.lit(" .")),
        F.lit("this is no statement"),
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select(F.explode(lines).alias("value"))


def quads_parsed(spark, sf_dir: str) -> DataFrame:
    rows = files.quads(_quads(spark, sf_dir)).where(F.col("predicate").endswith("name") | F.col("predicate").endswith("offers"))
    return rows.select("subject", F.substring_index("predicate", "/", -1).alias("name"), "kind", "object", "graph")


def quads_products(spark, sf_dir: str) -> DataFrame:
    """Products that no other node refers to, with their properties."""
    rows = files.products_of(files.quads(_quads(spark, sf_dir)))
    return rows.select("subject", F.array_join(F.map_keys("properties"), ",").alias("names"), F.col("properties")["name"][0].alias("name"))


def bulk_lines_checked(spark, sf_dir: str) -> DataFrame:
    """An order's lines as a paste: addresses of parts modulo 40, drafts, and lines that are neither; three lines pass."""
    part = F.col("l_partkey") % 40
    value = F.when(part < 25, F.concat(F.lit("https://shop.example/"), part)).when(part < 35, F.concat(F.lit("Tee\t"), part)).otherwise(F.lit("a tee"))
    at = F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("at"), value.alias("value")).dropDuplicates(["l_orderkey", "at"])
    return files.bulk_lines(rows, "l_orderkey", 3).groupBy("kind", "problem").agg(F.count("*").alias("n"), F.count("url").alias("urls"), F.count("title").alias("titles"))


QUERIES = {
    f.__name__: f
    for f in (
        records_strict, records_tolerant, records_bad_lines, records_with_separators, records_any_format, prompts_checked, stores_in_use,
        quads_parsed, quads_products, bulk_lines_checked,
    )
}

ORACLE_SQL = {
    "records_strict": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "records_tolerant": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 10 <> 0",
    "records_bad_lines": "SELECT count(*) FILTER (c_custkey % 10 <> 0) AS good_lines, count(*) FILTER (c_custkey % 10 = 0) AS bad_lines FROM customer",
    "records_with_separators": "SELECT c_custkey, length(c_name) + 5 AS chars FROM customer",
    "records_any_format": "SELECT n_nationkey, n_name, unnest(['lines', 'array']) AS format FROM nation",
    "prompts_checked": """WITH p AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE p_partkey END AS id, p_partkey FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM p)
      SELECT CASE WHEN p_partkey % 9 = 0 THEN 'missing field' WHEN p_partkey % 11 = 0 THEN 'unknown split' WHEN n > 1 THEN 'repeated id' END AS problem, count(*) AS n, 2 * count(*) AS candidates FROM c GROUP BY 1""",
    "stores_in_use": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0",
    "quads_parsed": """SELECT '_:n' || p_partkey AS subject, 'name' AS name, 'literal' AS kind, 'a "' || p_name || '" é' AS object, 'http://shop.example/' || p_partkey AS graph FROM part
      UNION ALL SELECT '_:n' || p_partkey, 'offers', 'blank', '_:o' || p_partkey, 'http://shop.example/' || p_partkey FROM part""",
    "quads_products": """SELECT '_:n' || p_partkey AS subject, 'name,offers,type' AS names, 'a "' || p_name || '" é' AS name FROM part""",
    "bulk_lines_checked": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber * 10000000 + l_partkey AS l_linenumber, l_partkey % 40 AS p FROM lineitem),
        k AS (SELECT *, CASE WHEN p < 25 THEN 'url' WHEN p < 35 THEN 'draft' ELSE 'none' END AS kind, row_number() OVER (PARTITION BY l_orderkey, least(p, 35) ORDER BY l_linenumber) AS seen FROM l),
        c AS (SELECT *, sum((kind <> 'none' AND seen = 1)::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM k)
      SELECT kind, CASE WHEN kind = 'none' THEN 'not an address or draft' WHEN seen > 1 THEN 'repeated' WHEN n > 3 THEN 'too many' END AS problem, count(*) AS n, count(*) FILTER (kind = 'url') AS urls,
        count(*) FILTER (kind = 'draft') AS titles FROM c GROUP BY 1, 2""",
}
