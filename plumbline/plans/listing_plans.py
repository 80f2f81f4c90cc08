"""Vocabularies, filters and address rules over tables: an order is a listing, its lines are phrases of its title and description; pages are
checked as they are, and as robots files and redirects treat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import listings as g
from plumbline.functions import text as t
from plumbline.functions import urls
from plumbline.functions import vocabulary as v
from plumbline.storage import spread, table

VOCABULARIES = {
    "fit": v.FIT, "sleeve": v.SLEEVE, "neckline": v.NECKLINE, "pattern": v.PATTERN, "product_type": v.PRODUCT_TYPE, "audience": v.AUDIENCE, "fabric_type": v.FABRIC_TYPE,
    "texture": v.TEXTURE, "shirt_length": v.SHIRT_LENGTH, "style": v.STYLE, "collar": v.COLLAR_TYPE,
}
#: What a line says, by the number of its part; # stands for the line's quantity.
PHRASES = [
    "Slim fit tee", "oversized Henley", "Camisa de manga larga", "crew neck", "V-neck T-Shirt", "striped polo", "a rayas y cuadros", "Men's shirt", "camiseta para mujer", "kids", "Oxford work shirt", "ribbed knit",
    "rib collar", "single jersey fabric", "piqué cotton", "super soft", "brushed waffle", "cropped top", "long line shirt", "vintage tees", "casual style", "button-down collar", "cuello mao", "Machine wash cold",
    "Do not tumble dry", "tumble dry low, cool iron", "do not iron", "Navy Blue", "white", "gris oscuro", "Zip hoodie", "coffee mug", "# ml bottle", "green tea # g", "Rib Tank Top", "sleeveless", "shirt jacket", "Sold out",
    "In stock now", "pre-order", "only $#.95", "# € today", "USD #", "#% off, £#", "Dress shirt", "plain thing", "", "band shirt + CD", "Flannel shirt", "sweatshirt", "hats & caps", "short sleeves",
]
#: Robots files that sites have, by the number of the page.
ROBOTS = [
    "User-agent: *\nDisallow: /en\nAllow: /en/2", "User-agent: *\nDisallow: /*.html$ # none", "User-agent: plumbline\nDisallow: /de\n\nUser-agent: *\nDisallow: /", "User-agent: a\nUser-agent: *\nDisallow:\nDisallow: /fr/1*7", "", None,
    "Disallow: /\nUser-agent: other\nDisallow: /", "user-agent: *\ndisallow: /e\nallow: /e",
]
AGENT = "plumbline"


def _listings(spark, sf_dir: str) -> DataFrame:
    """(l_orderkey, title, description): an order's first line, and the others."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("l_partkey") % len(PHRASES)).cast("int"))
    said = lines.withColumn("said", F.replace(phrase, F.lit("#"), F.col("l_quantity").cast("int").cast("string")))
    listed = spread(said.drop("l_quantity"), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "said"))).getField("said").alias("xs"))
    return listed.select("l_orderkey", F.get("xs", F.lit(0)).alias("title"), F.array_join(F.slice("xs", 2, F.size("xs")), ". ").alias("description"))


def listing_attributes(spark, sf_dir: str) -> DataFrame:
    """What each vocabulary finds in a listing: all its values, and the earliest in title or else description; colour, care and type."""
    title, rest = F.col("title"), F.col("description")
    whole = F.concat_ws(". ", title, rest)
    found: list[Column] = []
    for name, vocabulary in VOCABULARIES.items():
        found += [F.array_join(v.all_hits(whole, vocabulary), ",").alias(name), v.first_hit([title, rest], vocabulary).alias(f"{name}_first")]
    sleeve = v.first_hit([title, rest], v.SLEEVE)
    read = _listings(spark, sf_dir).select(
        "l_orderkey", *found, v.color(title).alias("color"), F.array_join(v.care(whole), ",").alias("care"), v.settled_type([title, rest], sleeve).alias("settled"),
        v.goods_type([title, rest], sleeve).alias("goods"),
    )
    return read.select("*", "goods.kind", "goods.type").drop("goods")


def listing_decisions(spark, sf_dir: str) -> DataFrame:
    """Which listings are shirts, tees, other goods or tank tops, and what they say of stock and price."""
    title, rest = F.col("title"), F.col("description")
    tank, price = g.tank_word(title, rest), g.price_in_text(F.concat_ws(". ", title, rest))
    return _listings(spark, sf_dir).select(
        "l_orderkey", g.is_shirt(title, F.lit(None).cast("string"), rest).alias("shirt"), g.is_shirt(title, F.lit(""), rest, True).alias("tee"), g.non_apparel(title).alias("rejected"),
        tank["word"].alias("tank_word"), tank["field"].alias("tank_field"), g.stock_state(F.concat_ws(". ", title, rest)).alias("stock"), price["price"].alias("price"), price["currency"].alias("currency"),
    )


def page_checks(spark, sf_dir: str) -> DataFrame:
    """Pages' keys, whether they may be fetched and read, whether a redirect went home, and whether they are bot checks (every
    seventh has such a title)."""
    page, url = F.col("page_id"), F.col("url")
    robots = F.get(F.array(*map(F.lit, ROBOTS)), (page % len(ROBOTS)).cast("int"))
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)?", 1)
    final = F.when(page % 4 == 0, F.regexp_extract("url", r"^([a-z]+://[^/]*)", 1)).when(page % 4 == 1, F.concat(F.regexp_extract("url", r"^([a-z]+://[^/]*)", 1), F.lit("/Search?q=1"))).otherwise(url)
    html = F.when(page % 7 == 0, F.regexp_replace("html", "<title>[^<]*", "<title>Just a moment...")).otherwise(F.col("html"))
    asked = F.when(page % 9 == 0, F.regexp_replace("url", "://[^/]*", "://10.0.0.7:80")).when(page % 9 == 1, F.regexp_replace("url", "^[a-z]+:", "ftp:")).otherwise(url)
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.page_key(url).alias("page_key"), urls.capture_key(url).alias("capture_key"), g.url_problem(asked).alias("problem"), g.robots_allow(robots, path, AGENT).alias("allowed"),
        g.went_home(url, final).alias("home"), g.is_challenge(html).alias("challenge"),
    )


def document_words(spark, sf_dir: str) -> DataFrame:
    """Documents folded to plain words, and their accented words, as digests and counts."""
    words = t.word_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.norm(F.col("text")), 256).alias("norm_sha256"), F.size(words).cast("long").alias("words"), F.sha2(F.array_join(words, " "), 256).alias("words_sha256"))


QUERIES = {f.__name__: f for f in (listing_attributes, listing_decisions, page_checks, document_words)}

_NORM = "trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"
ORACLE_SQL = {
    "document_words": f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9áéíóúñü]+'), lambda x: x <> '') AS w FROM documents)
      SELECT doc_id, sha256(CASE WHEN {_NORM} = '' THEN '  ' ELSE ' ' || {_NORM} || ' ' END) AS norm_sha256, len(w) AS words, sha256(array_to_string(w, ' ')) AS words_sha256 FROM w""",
}
