"""Text and listing functions over whole tables: a part's number picks the text that its listing carries.

Each query reads every row of ``part``, joins the text filed under p_partkey modulo the number of texts, and applies the
function. The oracle joins the values that the function must give, which are stated here beside the texts; so the
comparison holds each function against its expected values, text by text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import claims as c
from plumbline.functions import listings as g
from plumbline.functions import text as t
from plumbline.functions import urls
from plumbline.functions import vocabulary as v
from plumbline.storage import spread, table


@dataclass
class Cases:
    """Texts by number with the values that a function gives for them: ``given`` and ``out`` are columns with SQL types."""

    given: str
    out: str
    build: Callable[..., list[Column]]
    rows: list[tuple] = field(default_factory=list)

    def names(self, columns: str) -> list[str]:
        return [x.split()[0] for x in columns.split(", ")]

    def spark(self, spark, sf_dir: str) -> DataFrame:
        names = self.names(self.given)
        texts = [(i, *row[: len(names)]) for i, row in enumerate(self.rows)]
        filed = spark.createDataFrame(texts, f"i long, {self.given}")
        parts = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", (F.col("p_partkey") % len(texts)).alias("i"))
        found = self.build(*map(F.col, names))
        aliased = [x.alias(name) for x, name in zip(found, self.names(self.out), strict=True)]
        return parts.join(F.broadcast(filed), "i").select("p_partkey", *aliased)  # a few texts, all stated in this file

    def sql(self) -> str:
        n = len(self.names(self.given))
        outs = [x.split() for x in self.out.split(", ")]
        values = ", ".join(f"({i}, {', '.join(map(_literal, row[n:]))})" for i, row in enumerate(self.rows))
        cast = ", ".join(f"CAST(v.{name} AS {kind}) AS {name}" for name, kind in outs)
        return f"SELECT p_partkey, {cast} FROM part JOIN (VALUES {values}) v(i, {', '.join(n for n, _ in outs)}) ON p_partkey % {len(self.rows)} = v.i"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _list(values: Column) -> Column:
    return F.array_join(values, ",")


def _vocabulary(vocabulary: v.Table, *rows: tuple[str | None, str, str | None]) -> Cases:
    """All values that a text names in table order, and the earliest."""
    return Cases("text string", "hits VARCHAR, earliest VARCHAR", lambda x: [_list(v.all_hits(x, vocabulary)), v.earliest(x, vocabulary)], list(rows))


CASES: dict[str, Cases] = {
    "listing_fit": _vocabulary(
        v.FIT, ("Slim fit tee, oversized hood", "oversized,slim", "slim"), ("Corte regular, boxy", "relaxed,regular", "regular"),
        ("ATHLETIC-FIT shirt", "athletic", "athletic"), ("a plain shirt, slimming", "", None), ("Tailored fit", "tailored", "tailored"),
        ("Patrón regular", "regular", "regular"), (None, "", None), ("camisa holgada", "relaxed", "relaxed"),
    ),
    "listing_sleeve": _vocabulary(
        v.SLEEVE, ("Short sleeved polo", "short", "short"), ("manga larga", "long", "long"), ("Sleeveless tank top", "sleeveless", "sleeveless"),
        ("3/4 sleeve", "three_quarter", "three_quarter"), ("Long-sleeve over a short sleeve", "short,long", "long"), ("Kurzarm", "short", "short"), ("sleeves", "", None),
    ),
    "listing_neckline": _vocabulary(
        v.NECKLINE, ("crew neck", "crew", "crew"), ("V-neck tee", "v_neck", "v_neck"), ("cuello en v", "v_neck", "v_neck"), ("Scoop neckline", "scoop", "scoop"),
        ("Henley with round neckline", "crew,henley", "henley"), ("neck", "", None), ("crewneck", "crew", "crew"),
    ),
    "listing_pattern": _vocabulary(
        v.PATTERN, ("striped shirt", "striped", "striped"), ("camisa a rayas y cuadros", "striped,plaid", "striped"), ("Graphic print", "graphic,printed", "graphic"),
        ("solid color", "solid", "solid"), ("solid", "", None), ("Gingham, printed", "plaid,printed", "plaid"),
    ),
    "listing_product_type": _vocabulary(
        v.PRODUCT_TYPE, ("Oxford work shirt", "oxford,work_shirt,_shirt", "oxford"), ("Dress shirts", "_dress_shirt,_shirt", "_dress_shirt"),
        ("camiseta básica", "t_shirt", "t_shirt"), ("Overshirt", "overshirt", "overshirt"), ("Polo T-shirt", "polo,t_shirt,_shirt", "polo"), ("mug", "", None),
        ("shirt, henley", "henley,_shirt", "_shirt"),
    ),
    "listing_audience_words": _vocabulary(
        v.AUDIENCE, ("Men's tee", "men", "men"), ("women's shirt", "women", "women"), ("camiseta de niños", "kids", "kids"), ("kids, unisex", "unisex,kids", "kids"),
        ("mention", "", None), ("for women and men", "women,men", "women"),
    ),
    "listing_fabric_type": _vocabulary(
        v.FABRIC_TYPE, ("cotton twill tape", "", None), ("rib-knit collar", "", None), ("ribbed knit tee", "rib", "rib"), ("single jersey", "jersey", "jersey"),
        ("piqué cotton", "pique", "pique"), ("French terry and poplin", "french_terry,poplin", "french_terry"), ("jersey", "", None), ("tela de sarga", "twill", "twill"),
        ("slub jersey", "slub,jersey", "slub"), ("oxford cloth", "oxford", "oxford"),
    ),
    "listing_texture": _vocabulary(
        v.TEXTURE, ("super soft cotton", "soft", "soft"), ("ribbed tee", "ribbed", "ribbed"), ("ribbed cotton collar", "", None), ("waffle knit, brushed fleece", "brushed,waffle", "waffle"),
        ("soft", "", None), ("tejido texturizado de tacto suave", "textured,soft", "textured"),
    ),
    "listing_shirt_length": _vocabulary(
        v.SHIRT_LENGTH, ("cropped tee", "cropped", "cropped"), ("long line top", "longline", "longline"), ("Camiseta tipo túnica", "tunic", "tunic"),
        ("regular length, cropped fit", "cropped,regular", "regular"), ("length", "", None),
    ),
    "listing_style": _vocabulary(
        v.STYLE, ("vintage tees", "vintage", "vintage"), ("Streetwear shirt", "streetwear", "streetwear"), ("camisa deportiva", "athletic", "athletic"),
        ("basic shirt, casual tee", "basic,casual", "basic"), ("a basic choice", "", None), ("minimalist design", "minimalist", "minimalist"), ("graphic t-shirts", "graphic", "graphic"),
    ),
    "listing_collar": _vocabulary(
        v.COLLAR_TYPE, ("Button-down collar", "button_down", "button_down"), ("cuello mao", "mandarin", "mandarin"), ("mock neck", "mock_neck", "mock_neck"),
        ("v-neck or crew neck", "v_neck,crew", "v_neck"), ("polo", "", None), ("cuello tipo polo", "polo", "polo"),
    ),
    "listing_care": Cases(
        "text string", "care VARCHAR", lambda x: [_list(v.care(x))],
        [
            ("Machine wash cold. Do not tumble dry. Do not iron", "machine_wash,wash_cold,do_not_tumble_dry,do_not_iron"), ("Tumble dry low, iron low", "tumble_dry,iron_low"),
            ("No usar secadora", "do_not_tumble_dry"), ("Don't tumble dry; cool iron", "do_not_tumble_dry,iron_low"), ("Hand wash, dry clean", "hand_wash,dry_clean"),
            ("Tumble dry, but do not tumble dry hot", "do_not_tumble_dry"), ("Do not iron, or iron low", "do_not_iron"), (None, ""), ("lavar a mano con agua fría", "hand_wash,wash_cold"),
            ("do not bleach, do not dry clean", "do_not_bleach"),
        ],
    ),
    "listing_color": Cases(
        "text string", "color VARCHAR", lambda x: [v.color(x)],
        [
            ("Navy Blue", "navy"), ("black and white", None), ("gris oscuro", "grey"), ("Blanca", "white"), ("indigo", "blue"), ("sunset", None), (None, None),
            ("Heather Gray", "grey"), ("azul marino", "navy"), ("cream", "beige"), ("reddish", None),
        ],
    ),
    "listing_settled_type": Cases(
        "title string, description string, sleeve string", "settled VARCHAR", lambda x, y, s: [v.settled_type([x, y], s)],
        [
            ("Basic shirt", "short sleeves", "short", "short_sleeve_shirt"), ("Basic shirt", "a polo", None, "polo"), ("Dress shirt", None, None, "long_sleeve_shirt"),
            ("Camisa", "manga larga", "long", "long_sleeve_shirt"), ("Mug", "for coffee", None, None), ("Flannel shirt", None, "long", "flannel"), ("shirt", "shirt", "sleeveless", None),
        ],
    ),
    "listing_goods_kind": Cases(
        "title string, description string", "kind VARCHAR, type VARCHAR",
        lambda x, y: [v.goods_type([x, y], F.lit(None).cast("string"))["kind"], v.goods_type([x, y], F.lit(None).cast("string"))["type"]],
        [
            ("Zip hoodie", "goes with any t-shirt", "other", "hoodie"), ("Heavy tee", "no hoodie", "shirt", "t_shirt"), ("Polohemd", None, "shirt", "polo"), ("Hose", "schwarz", "other", "pants"),
            ("Gift", "a bottle", "other", "bottle"), ("Thing", "of beauty", "other", None), (None, "Chemise", "shirt", "unknown"),
        ],
    ),
    "shirt_titles": Cases(
        "title string, kind string, tags string", "shirt BOOLEAN, tee BOOLEAN", lambda x, k, y: [g.is_shirt(x, k, y), g.is_shirt(x, k, y, True)],
        [
            ("Heavy Tee", "", None, True, True), ("Sweatshirt", "shirts", None, False, False), ("Polo", None, "", True, False), ("Classic", "T-Shirt", None, True, True),
            ("Classic", None, "camiseta,blue", True, False), ("Shirt jacket", "", None, False, False), ("Camisa blanca", "", None, True, False), (None, None, None, False, False),
            ("Button-down tee", "", None, True, False),
        ],
    ),
    "non_apparel_titles": Cases(
        "title string", "rejected BOOLEAN", lambda x: [g.non_apparel(x)],
        [
            ("Green tea 100 g", True), ("Tee - relaxed cotton", False), ("Coffee mug", True), ("Mug print shirt", False), ("Band shirt + CD", True), ("PVC tee adapter", True),
            ("Chai tee", False), ("Sweatshirt", True), ("Cap sleeve top", False), (None, False), ("200 ml bottle", True), ("Hats & caps", True),
        ],
    ),
    "tank_words": Cases(
        "name string, title string", "word VARCHAR, field VARCHAR", lambda x, y: [g.tank_word(x, y)["word"], g.tank_word(x, y)["field"]],
        [("Rib Tank Top", "Tank", "Tank Top", "raw_product_name"), ("Tee", "Sleeveless tee", "Sleeveless", "raw_title"), ("Tee", None, None, None), (None, "cami", "cami", "raw_title")],
    ),
    "stock_words": Cases(
        "text string", "state VARCHAR", lambda x: [g.stock_state(x)],
        [
            ("Sold out, back in stock soon", "out_of_stock"), ("In stock now", "in_stock"), ("Pre-order today", "preorder"), ("agotada", "out_of_stock"), ("en stock", "in_stock"), ("stock", None),
            (None, None), ("on backorder", "backorder"), ("preventa, available now", "preorder"),
        ],
    ),
    "prices_in_text": Cases(
        "text string", "price DOUBLE, currency VARCHAR", lambda x: [g.price_in_text(x)["price"], g.price_in_text(x)["currency"]],
        [
            ("only $19.99 today", 19.99, "USD"), ("cuesta 25,50 € hoy", 25.5, "EUR"), ("MXN 300 or USD 15", 300.0, "MXN"), ("ABC 12 then GBP 9", 9.0, "GBP"), ("100 cotton", None, None),
            ("$20 % off, £8", 8.0, "GBP"), (None, None, None), ("30 eur", None, None),
        ],
    ),
    "draft_prices": Cases(
        "price string, currency string", "price DOUBLE, price_error VARCHAR, currency VARCHAR, currency_error VARCHAR",
        lambda p, q: [g.draft_price(p)["price"], g.draft_price(p)["error"], g.draft_currency(q)["currency"], g.draft_currency(q)["error"]],
        [
            ("19,99", "eur", 19.99, None, "EUR", None), ("0", "EURO", None, "invalid_price", None, "invalid_currency"), ("", None, None, None, None, None), (None, "", None, None, None, None),
            (" 5 ", " usd ", 5.0, None, "USD", None), ("1e9", "XXX", None, "invalid_price", None, "invalid_currency"), ("ten", "GBP", None, "invalid_price", "GBP", None), ("-3", "MXN", None, "invalid_price", "MXN", None),
        ],
    ),
    "draft_texts": Cases(
        "title string, description string, text string", "title VARCHAR, description VARCHAR, language VARCHAR",
        lambda x, y, z: [*(g.draft_parts(x, y, z)[k] for k in ("title", "description")), g.draft_language(F.concat_ws("\n", x, y, z))],
        [
            (None, None, " Heavy tee \n\n with short sleeves\nfor men", "Heavy tee", "with short sleeves\nfor men", "en"), ("Camisa", "para hombre", "corte suave", "Camisa", "para hombre\ncorte suave", "es"),
            ("", "", "", "", "", None), ("Tee", None, None, "Tee", "", "en"), (None, "x", "One line", "One line", "x", None),
        ],
    ),
    "url_problems": Cases(
        "url string", "problem VARCHAR", lambda u: [g.url_problem(u)],
        [
            ("https://shop.example/p/1", None), ("ftp://shop.example/", "scheme_or_host"), ("http://127.0.0.1/x", "not_public"), ("http://10.1.2.3", "not_public"), ("https://192.168.0.1:8080/", "not_public"),
            ("http://localhost/", "not_public"), ("shop.example", "scheme_or_host"), (None, "scheme_or_host"), ("http://172.15.0.1/", None), ("http://172.16.0.1/", "not_public"), ("http://[::1]/", "not_public"),
            ("HTTPS://user@8.8.8.8/", None), ("https:///p", "scheme_or_host"), ("http://100.64.0.9/", "not_public"),
        ],
    ),
    "url_match_keys": Cases(
        "url string", "page_key VARCHAR, capture_key VARCHAR", lambda u: [urls.page_key(u), urls.capture_key(u)],
        [
            ("https://www.Shop.example:443/P/1/?q=1#x", "shop.example/p/1", "shop.example/P/1?q=1"), ("http://shop.example", "shop.example", "shop.example"), ("nothing", None, ""), (None, None, None),
            ("//cdn.example/a?", "cdn.example/a", "cdn.example/a"),
        ],
    ),
    "redirects_home": Cases(
        "url string, final string", "home BOOLEAN", lambda u, f: [g.went_home(u, f)],
        [
            ("https://a.example/p/1", "https://a.example/", True), ("https://a.example/p/1", "https://a.example/p/2", False), ("https://a.example/", "https://a.example", False),
            ("https://a.example/p/1", "https://a.example/Search?q=1", True), ("https://a.example/search/x", "https://a.example/search", False),
        ],
    ),
    "challenge_pages": Cases(
        "html string", "challenge BOOLEAN", lambda h: [g.is_challenge(h)],
        [
            ("<html><title>Just a moment...</title></html>", True), ("<title>Heavy tee</title>", False), ("<title>x</title><script>cf-chl</script>", True),
            ('<script type="application/ld+json"></script><i>cf-chl</i>', False), (None, False), ("<TITLE lang='en'>\nAccess Denied</TITLE>", True),
        ],
    ),
    "robots_rules": Cases(
        "robots string, path string", "allowed BOOLEAN", lambda r, p: [g.robots_allow(r, p, "plumbline")],
        [
            ("User-agent: *\nDisallow: /p", "/p/1", False), ("User-agent: *\nDisallow: /p\nAllow: /p/1", "/p/1", True), ("User-agent: plumb\nDisallow: /a\n\nUser-agent: *\nDisallow: /", "/b", True),
            ("User-agent: *\nDisallow: /*.pdf$", "/x/a.pdf", False), ("User-agent: *\nDisallow: /*.pdf$", "/x/a.pdf?x", True), ("", "/", True), (None, "/a", True), ("Disallow: /", "/a", True),
            ("User-agent: a\nUser-agent: *\nDisallow: /q # all", "/q", False), ("User-agent: *\nDisallow:", "/a", True), ("User-agent: *\nDisallow: /p\nAllow: /p", "/p", True), ("User-agent: *\nDisallow: /a.b", "/axb", True),
        ],
    ),
    "recorded_links_dead": Cases(
        "status string", "dead BOOLEAN", lambda s: [g.link_dead(s)],
        [("200", False), ("404", True), ("301", True), ("Gone", True), ("ok", False), (None, False), ("redirected", True), ("", False), ("299", False)],
    ),
    "policy_modes": Cases(
        "action string", "mode VARCHAR",
        lambda a: [g.allowed_mode(a, {"read": "auto", "publish": "approve", "alter_log": "forbidden"})],
        [("read", "auto"), ("publish", "approve"), ("alter_log", "forbidden"), ("anything", "forbidden"), (None, "forbidden")],
    ),
    "folded_names": Cases(
        "text string", "norm VARCHAR", lambda x: [t.norm(x)],
        [
            ("Café — Niño's  TEE", " cafe nino s tee "), ("  ", "  "), (None, "  "), ("ＡＢＣ①²", " abc12 "), ("Straße", " stra e "), ("áb", " ab "), ("Ångström-Test", " angstrom test "), ("naïve\tÇa", " naive ca "),
        ],
    ),
    "language_codes": Cases(
        "tag string", "code VARCHAR", lambda x: [t.language_code(x)],
        [("en-US", "en"), ("es_MX", "es"), ("EN", "en"), ("Other", "other"), ("", None), (None, None), (" pt ", "pt"), ("zh-Hant-TW", "zh"), ("a", "a")],
    ),
    "word_tokens": Cases(
        "text string", "tokens VARCHAR", lambda x: [_list(t.word_tokens(x))],
        [("Algodón, 100% SUAVE!", "algodón,100,suave"), ("", ""), ("niño-pingüino_x", "niño,pingüino,x"), ("über", "über")],
    ),
    "sentence_claims": Cases(
        "text string", "claims VARCHAR",
        lambda x: [F.array_join(F.transform(c.claims(x), lambda k: F.concat(F.substring_index(k.field, ".", -1), F.lit("="), k.value, F.coalesce(F.concat(F.lit("@"), k.number.cast("string")), F.lit("")))), ";")],
        [
            (
                "100% cotton, slim fit, long sleeve, 180 gsm, $19.99, in sizes XS-XL. Made in Spain, GOTS certified.",
                "material_percentages=cotton:100.0;fit=slim;sleeve_length=long;fabric_weight_gsm=180@180.0;price=USD MXN CAD AUD@19.99;sizes=XS;sizes=S;sizes=M;sizes=L;sizes=XL;origin=spain;certification=gots",
            ),
            ("Slim or relaxed, crew neck, for men", "neckline=crew;audience=men"), ("Comes in navy blue and white.", "colors=white;colors=navy"), ("25,50 euros o 30 EUR", "price=EUR@25.5;price=EUR@30.0"),
            ("Fabricado en España, tallas S a L, 2XL", "sizes=S;sizes=M;sizes=L;sizes=XXL;origin=spain"), ("", ""), (None, ""), ("60% cotton, 40% polyester, OEKO-TEX", "material_percentages=cotton:60.0,polyester:40.0;certification=oeko_tex"),
            ("A nice tee for you", ""), ("black, blue", "colors=black;colors=blue"), ("US$5 and 12345 EUR", "price=USD@5.0;price=EUR@2345.0"), ("made in the United States of old", "origin=usa"),
        ],
    ),
}

QUERIES = {name: cases.spark for name, cases in CASES.items()}
ORACLE_SQL = {name: cases.sql() for name, cases in CASES.items()}
