"""Column names and types of the canonical tables."""

from __future__ import annotations

PRODUCT_SNAPSHOT = """
    timestamp timestamp_ntz, product_id bigint, sku_id bigint, title string,
    rating decimal(9,2), latest_category_id bigint, reviews_amount bigint,
    total_orders_amount bigint, total_available_amount bigint, available_amount bigint,
    attributes array<string>, tags array<string>, photo_key string,
    characteristics map<string,string>, seller_id bigint, seller_account_id bigint,
    seller_title string, seller_link string, seller_registration_date timestamp_ntz,
    seller_rating decimal(9,2), seller_reviews_count bigint, seller_orders bigint,
    seller_contacts map<string,string>, is_eco boolean, is_adult boolean,
    full_price bigint, purchase_price bigint, restriction smallint
"""

PRODUCT_POSITION = """
    timestamp timestamp_ntz, product_id bigint, sku_id bigint, category_id bigint,
    position bigint
"""

CATEGORY_EDGE = "category_id bigint, parent_category_id bigint, title string"

SELLER = "seller_id bigint, account_id bigint, link string, title string"

ENVELOPE = "event_id string, scrap_time timestamp_ntz, kind string, payload string"

PRODUCT_PAYLOAD = """
    product_id bigint, title string, orders bigint, total_available_amount bigint,
    reviews_amount bigint, rating decimal(9,2), is_eco boolean, is_adult boolean,
    attributes array<string>, tags array<string>,
    category struct<id: bigint, title: string>,
    seller struct<id: bigint, account_id: bigint, seller_link: string,
        seller_title: string, reviews: bigint, orders: bigint, rating: decimal(9,2),
        registration_seconds: bigint,
        contacts: array<struct<type: string, value: string>>>,
    skus array<struct<sku_id: bigint, purchase_price: string, full_price: string,
        available_amount: bigint, photo_key: string,
        characteristics: array<struct<type: string, title: string>>,
        restricted_amount: smallint>>
"""

POSITION_PAYLOAD = """
    product_id bigint, sku_id bigint, category_id bigint, position bigint
"""

# Children stay JSON text and are parsed one level at a time.
CATEGORY_PAYLOAD = "category_id bigint, title string, children array<string>"
