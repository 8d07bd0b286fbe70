"""Retailers' payloads as observations: two JSON shapes and two HTML shapes, all by column expressions.

Every function gives the columns product_id, name, brand, gtin, categories, image, regular_cents, promo_cents,
member_cents, comparative, promotion (struct) and retailer_product_id, for rows that have an id and a price.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceengine.functions.markup import blocks, capture, decoded, multibuy, visible
from priceengine.functions.scalars import dollars_to_cents, half_up, money, title_slug, url_part

PROMOTION = "struct<id:string,type:string,member_only:boolean,save_cents:bigint,save_percent:double,threshold:bigint,starts_at:string,ends_at:string>"
S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_PROMO_A = _fields(promoId=S, rewardType=S, bestPromotion=B, threshold=L, cardDependencyFlag=B)
#: JSON shape A: whole cents, a list of promotions, no price before.
SHAPE_A = _fields(
    productId=S, brand=S, name=S, displayName=S, units=S, unitPrice=S, decalCode=S, price=D, singlePrice=_fields(price=D), multiPrice=_fields(price=D),
    promotions=T.ArrayType(_PROMO_A), categories=T.ArrayType(S), categoryTrees=T.ArrayType(_fields(level0=S, level1=S, level2=S)), productImageUrls=T.MapType(S, S),
)
#: JSON shape B: dollars, a sale or a club price.
SHAPE_B = _fields(
    sku=S, barcode=S, name=S, brand=S, slug=S, productTag=_fields(tagType=S),
    price=_fields(originalPrice=D, salePrice=D, savePrice=D, savePercentage=D, isClubPrice=B, isSpecial=B, promotionStartDate=S, promotionEndDate=S),
    size=_fields(cupPrice=D, cupMeasure=S, volumeSize=S), departments=T.ArrayType(_fields(name=S)), images=T.MapType(S, S),
)
#: JSON in the attribute of an HTML tile.
SHAPE_TILE = _fields(id=S, name=S, brand=S, price=S, productThenPrice=S, productEAN=S, category=S, productBadges=S, promotionCallOutMessage=S, marketplaceProduct=S)


def promotion_struct(**parts: Column) -> Column:
    """PROMOTION with the given fields, others null."""
    kinds = T._parse_datatype_string(PROMOTION)
    return F.struct(*[parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def whole(x: Column) -> Column:
    """A number without fraction as a long, else null."""
    return F.when(x == F.floor(x), x.cast("long"))


def price_in_cents(p: Column) -> Column:
    """Of shape A: the product's own price, else that of a single item, else that of several."""
    return F.coalesce(whole(p["price"]), whole(p["singlePrice"]["price"]), whole(p["multiPrice"]["price"]))


def best_promotion(promotions: Column, decal: Column) -> Column:
    """The first one marked as best, else the first, else one made from the decal."""
    best = F.try_element_at(F.filter(promotions, lambda x: F.coalesce(x["bestPromotion"], F.lit(False))), F.lit(1))
    made = F.struct(
        F.concat(F.lit("decal:"), decal).alias("promoId"), F.lit("SPECIAL").alias("rewardType"), F.lit(None).cast("boolean").alias("bestPromotion"),
        F.lit(None).cast("long").alias("threshold"), F.lit(False).alias("cardDependencyFlag"),
    )
    return F.coalesce(best, F.try_element_at(promotions, F.lit(1)), F.when(decal != "", made))


def kept(row: Column, keep: Callable[[Column], Column]) -> Column:
    """A generator of `row` where it fits. Unlike a filter it is never moved below the parsing, which so happens once."""
    return F.explode(F.filter(F.array(row), keep))


def shape_a(raw: DataFrame, payload: str = "payload", namespace: str = "foodstuffs") -> DataFrame:
    """Shape A. With a promotion the price is both the regular and the promotional one, as no price before is told."""
    p = F.col("p")
    found = kept(F.from_json(payload, SHAPE_A), lambda x: price_in_cents(x).isNotNull() & x["productId"].isNotNull())
    rows = raw.select(found.alias("p")).withColumns({"cents": price_in_cents(p), "promo": best_promotion(p["promotions"], p["decalCode"])})
    tree = F.try_element_at(p["categoryTrees"], F.lit(1))
    promo = F.col("promo")
    return rows.select(
        F.concat(F.lit(f"{namespace}:"), F.lower(p["productId"])).alias("product_id"),
        F.concat_ws(" ", F.nullif(p["name"], F.lit("")), F.nullif(F.coalesce(p["displayName"], p["units"]), F.lit(""))).alias("name"), F.nullif(p["brand"], F.lit("")).alias("brand"),
        F.lit(None).cast("string").alias("gtin"), F.coalesce(p["categories"], F.when(tree.isNotNull(), F.filter(F.array(tree["level0"], tree["level1"], tree["level2"]), lambda c: c != ""))).alias("categories"),
        F.to_json(p["productImageUrls"]).alias("image"), F.col("cents").alias("regular_cents"), F.when(promo.isNotNull(), F.col("cents")).alias("promo_cents"),
        F.lit(None).cast("long").alias("member_cents"), p["unitPrice"].alias("comparative"),
        F.when(promo.isNotNull(), promotion_struct(id=promo["promoId"], type=promo["rewardType"], member_only=F.coalesce(promo["cardDependencyFlag"], F.lit(False)), threshold=F.nullif(promo["threshold"], F.lit(0)))).alias("promotion"),
        p["productId"].alias("retailer_product_id"),
    )


def sized_name(name: Column, size: Column) -> Column:
    """The name with the size behind it, unless it already holds it in any case."""
    bare, tail = F.trim(name), F.nullif(F.trim(size), F.lit(""))
    return F.when(tail.isNull() | F.coalesce(F.contains(F.lower(bare), F.lower(tail)), F.lit(False)), bare).otherwise(F.concat_ws(" ", bare, tail))


def shape_b(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Shape B. A club price is the members' price and no promotional one."""
    p = F.col("p")
    price = p["price"]
    paid = lambda x: F.coalesce(x["price"]["salePrice"], x["price"]["originalPrice"])
    rows = raw.select(kept(F.from_json(payload, SHAPE_B), lambda x: paid(x).isNotNull() & (x["sku"] != "")).alias("p")).withColumn("cents", dollars_to_cents(paid(p)))
    club = F.coalesce(price["isClubPrice"], F.lit(False))
    special = F.coalesce(price["isSpecial"], F.lit(False)) | F.coalesce(p["productTag"]["tagType"] == "IsSpecial", F.lit(False))
    departments = F.filter(F.transform(p["departments"], lambda d: d["name"]), lambda c: c != "")
    promotion = promotion_struct(
        id=F.concat_ws(":", F.lit("woolworths"), p["sku"], price["promotionStartDate"], price["promotionEndDate"], F.col("cents").cast("string")),
        type=F.when(club, "MEMBER_PRICE").otherwise("SPECIAL"), member_only=club, save_cents=dollars_to_cents(price["savePrice"]), save_percent=price["savePercentage"],
        starts_at=price["promotionStartDate"], ends_at=price["promotionEndDate"],
    )
    return rows.select(
        F.concat(F.lit("woolworths:"), p["sku"]).alias("product_id"), sized_name(p["name"], p["size"]["volumeSize"]).alias("name"), F.nullif(p["brand"], F.lit("")).alias("brand"),
        F.nullif(p["barcode"], F.lit("")).alias("gtin"), F.when(F.size(departments) > 0, departments).alias("categories"), F.to_json(p["images"]).alias("image"),
        F.coalesce(dollars_to_cents(price["originalPrice"]), F.col("cents")).alias("regular_cents"), F.when(special & ~club, F.col("cents")).alias("promo_cents"), F.when(club, F.col("cents")).alias("member_cents"),
        F.when(p["size"]["cupPrice"].isNotNull(), F.concat(F.format_string("$%.2f / ", p["size"]["cupPrice"]), F.coalesce(p["size"]["cupMeasure"], F.lit("undefined")))).alias("comparative"),
        F.when(club | special, promotion).alias("promotion"), p["sku"].alias("retailer_product_id"),
    )


def _saving(before: Column, now: Column) -> dict[str, Column]:
    less = before > now
    return {
        "save_cents": F.when(less, before - now),
        "save_percent": F.when(less, half_up((before - now).cast("double") / before.cast("double") * F.lit(10000.0)).cast("double") / F.lit(100.0)),
    }


# Fixed value: the markup of the page.
LINE_MARKER = r'<div class="talker [^"]*"[^>]*data-talker[^>]*id="line_[^"]+"[^>]*>'


def storefront(pages: DataFrame, html: str = "html") -> DataFrame:
    """HTML of product lines, one block each: now and before prices, the special flag among the classes."""
    head = r'^<div class="talker ([^"]*)"[^>]*data-talker[^>]*id="line_([^"]+)"[^>]*>'

    def line(b: Column) -> Column:
        name = F.coalesce(capture(b, r'<div class="talker__name[^>]*"[^>]*title="([^"]*)"'), capture(b, r'(?s)<span class="talker__product-name">(.*?)</span>'))
        return F.struct(
            F.regexp_extract(b, head, 1).alias("classes"), F.regexp_extract(b, head, 2).alias("id"), visible(name).alias("name"),
            money(visible(capture(b, r'(?s)<strong class="price__sell"[^>]*>(.*?)</strong>'))).alias("sell"), money(visible(capture(b, r'(?s)<span class="talker__prices__was[^>]*>(.*?)</span>'))).alias("was"),
            visible(capture(b, r'(?s)<span class="price__units[^>]*>(.*?)</span>')).alias("unit"), visible(capture(b, r'(?s)<span class="[^"]*talker__prices__comparison[^"]*"[^>]*>(.*?)</span>')).alias("compared"),
            decoded(capture(b, r'<img[^>]+src="([^"]+)"')).alias("image"),
        )

    found = F.filter(F.transform(blocks(F.col(html), LINE_MARKER), line), lambda r: (r["id"] != "") & (r["name"] != "") & r["sell"].isNotNull())
    rows = pages.select(F.inline(found)).withColumn("regular", F.coalesce("was", "sell"))
    special = F.col("classes").rlike(r"(?:^|\s)(?:special|talker--Special)(?:\s|$)") | (F.col("regular") > F.col("sell"))
    promotion = promotion_struct(id=F.concat_ws(":", F.lit("freshchoice"), F.col("id"), F.col("regular").cast("string"), F.col("sell").cast("string")), type=F.lit("SPECIAL"), member_only=F.lit(False), **_saving(F.col("regular"), F.col("sell")))
    return rows.select(
        F.concat(F.lit("freshchoice:"), F.col("id")).alias("product_id"), "name", F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("gtin"), F.lit(None).cast("array<string>").alias("categories"),
        "image", F.col("regular").alias("regular_cents"), F.when(special, F.col("sell")).alias("promo_cents"), F.lit(None).cast("long").alias("member_cents"),
        F.coalesce(F.nullif("compared", F.lit("")), F.nullif("unit", F.lit(""))).alias("comparative"), F.when(special, promotion).alias("promotion"), F.col("id").alias("retailer_product_id"),
    )


# Fixed value: the markup of the page.
TILE_MARKER = r'<div class="product-tile"[^>]*data-gtm-product="[^"]+"[^>]*>'


def tiles(pages: DataFrame, html: str = "html", origin: str = "https://www.thewarehouse.co.nz", marketplace: bool = False) -> DataFrame:
    """HTML of product tiles with JSON in an attribute; tiles whose JSON cannot be read go, and other sellers' products unless `marketplace`."""
    p = F.col("p")

    def tile(b: Column) -> Column:
        return F.struct(
            F.from_json(decoded(F.regexp_extract(b, r'data-gtm-product="([^"]+)"', 1)), SHAPE_TILE).alias("p"),
            decoded(capture(b, r'(?s)<img.*?class="[^"]*tile-image[^"]*".*?src="([^"]+)"')).alias("image"),
            decoded(capture(b, r'<a href="([^"]+)"[^>]*class="[^"]*embed-responsive')).alias("path"),
        )

    price = lambda x: x["price"].try_cast("double")
    own = lambda x: F.lit(marketplace) | F.coalesce(F.lower(x["marketplaceProduct"]), F.lit("")).isin("", "false", "0", "null")
    found = F.filter(F.transform(blocks(F.col(html), TILE_MARKER), tile), lambda r: (r["p"]["id"] != "") & (r["p"]["name"] != "") & price(r["p"]).isNotNull() & own(r["p"]))
    rows = pages.select(F.inline(found)).withColumns({
        "now": dollars_to_cents(price(p)), "before": dollars_to_cents(p["productThenPrice"].try_cast("double")), "offer": multibuy(p["promotionCallOutMessage"]),
    })
    rows = rows.withColumns({"regular": F.greatest("now", "before"), "promo": F.coalesce(F.col("offer.unit_cents"), F.col("now"))})
    known = lambda c: F.nullif(F.nullif(c, F.lit("na")), F.lit(""))
    special = F.col("offer").isNotNull() | F.coalesce(F.col("before") > F.col("now"), F.lit(False)) | F.coalesce(F.contains(p["productBadges"], F.lit("special")), F.lit(False))
    promotion = promotion_struct(
        id=F.concat_ws(":", F.lit("warehouse"), p["id"], F.col("regular").cast("string"), F.col("promo").cast("string")), type=F.when(F.col("offer").isNotNull(), "MULTIBUY").otherwise("SPECIAL"),
        member_only=F.lit(False), threshold=F.col("offer.quantity"), **_saving(F.col("regular"), F.col("promo")),
    )
    parts = F.filter(F.split(p["category"], "/"), lambda c: c != "")
    return rows.select(
        F.concat(F.lit("warehouse:"), p["id"]).alias("product_id"), p["name"].alias("name"), known(p["brand"]).alias("brand"), known(p["productEAN"]).alias("gtin"), F.when(F.size(parts) > 0, parts).alias("categories"),
        "image", F.col("regular").alias("regular_cents"), F.when(special, F.col("promo")).alias("promo_cents"), F.lit(None).cast("long").alias("member_cents"), F.lit(None).cast("string").alias("comparative"),
        F.when(special, promotion).alias("promotion"), p["id"].alias("retailer_product_id"),
        product_page(origin, F.coalesce(F.nullif("path", F.lit("")), F.concat(F.lit("/p/"), p["id"], F.lit(".html")))).alias("source_url"),
    )


# Fixed value: the markup of the page.
CARD_MARKER = r'<div class="StoreCard(?:\s[^"]*)?"[^>]*>'


def store_cards(pages: DataFrame, domain: str, html: str = "html", retailer: str = "freshchoice", label: str = "FreshChoice") -> DataFrame:
    """(store_id, slug, name, address, origin) of the cards on store pages, the first of each slug of a page; where a page has no card, of the bare origins `https://<slug>.<domain>`."""
    host = domain.replace(".", r"\.")
    b = F.col("card.block")
    lines = F.transform(F.split(F.coalesce(capture(b, r'(?is)<span class="StoreCard__Details">(.*?)</span>'), F.lit("")), r"(?i)<br\s*/?>"), visible)
    lines = F.filter(lines, lambda s: (s != "") & ~s.rlike(r"(?i)^(?:open|closed)\b"))
    on_map = F.trim(decoded(F.replace(F.coalesce(capture(b, r"""(?i)maps\.google\.com\?q=([^"'#]+)"""), F.lit("")), F.lit("+"), F.lit(" "))))
    name = visible(capture(b, r'<span class="StoreCard__Name">([^<]+)</span>'))
    numbered = pages.withColumn("__page", F.monotonically_increasing_id())
    cards = numbered.select("__page", F.posexplode(blocks(F.col(html), CARD_MARKER)).alias("place", "block")).select("__page", F.struct("place", "block").alias("card"))
    found = cards.select(
        "__page", F.col("card.place").alias("place"), F.lower(capture(b, rf'(?i)href="https://([a-z0-9-]+)\.{host}(?:/[^"]*)?"')).alias("slug"),
        F.when(name.startswith(label), name).otherwise(F.concat(F.lit(f"{label} "), name)).alias("name"), F.nullif(F.when(F.size(lines) > 0, F.array_join(lines, ", ")).otherwise(on_map), F.lit("")).alias("address"),
    ).where(F.col("slug").isNotNull() & F.col("name").isNotNull())
    bare = numbered.join(found.select("__page").distinct(), "__page", "left_anti").select(
        "__page", F.posexplode(F.transform(F.regexp_extract_all(html, F.lit(rf"(?i)https://([a-z0-9-]+)\.{host}"), 1), F.lower)).alias("place", "slug")
    ).select("__page", "place", "slug", F.concat(F.lit(f"{label} "), title_slug(F.col("slug"))).alias("name"), F.lit(None).cast("string").alias("address"))
    first = found.unionByName(bare).groupBy("__page", "slug").agg(F.min_by(F.struct("name", "address"), F.col("place")).alias("row"))
    return first.select(
        F.concat(F.lit(f"{retailer}:"), F.col("slug")).alias("store_id"), "slug", F.lit(retailer).alias("retailer"), "row.name", "row.address", F.concat(F.lit("https://"), F.col("slug"), F.lit(f".{domain}")).alias("origin")
    )


def last_by_id(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Pages may repeat a product: the last one stays."""
    return rows.groupBy("product_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "product_id"]), F.col(order)).alias("row")).select("product_id", "row.*")


def product_page(origin: str, path: Column) -> Column:
    """The address of a product at its retailer: an absolute path under the origin, or an address as it is."""
    return F.when(path.rlike(r"^https?://"), path).otherwise(F.concat(F.lit(origin.rstrip("/")), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))


def details_path(sku: Column, name: Column) -> Column:
    return F.concat(F.lit("/shop/productdetails?stockcode="), url_part(sku), F.lit("&name="), url_part(F.coalesce(name, F.lit("product"))))


def collector_line(rows: DataFrame) -> DataFrame:
    """The price a collector prints: promotional, else members', else regular."""
    return rows.withColumn("shown_cents", F.coalesce("promo_cents", "member_cents", "regular_cents"))
