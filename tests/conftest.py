import datetime as dt
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tallymart import Marketplace, build_session, schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    session = build_session("tests", "local[8]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EDGES = [(1, 0, "root"), (2, 1, "two"), (3, 1, "three"), (4, 2, "four")]

DEFAULTS = {
    "product_id": 1,
    "sku_id": 10,
    "title": "A",
    "rating": None,
    "latest_category_id": 4,
    "reviews_amount": 0,
    "total_orders_amount": 0,
    "total_available_amount": 0,
    "available_amount": 0,
    "photo_key": "ph",
    "seller_id": 7,
    "seller_account_id": 70,
    "seller_title": "Shop",
    "seller_link": "shop",
    "full_price": None,
    "purchase_price": 100,
    "restriction": 0,
}


@pytest.fixture(scope="session")
def snapshots(spark):
    """Build raw snapshots from partial rows given as dicts."""
    schema = spark.createDataFrame([], schemas.PRODUCT_SNAPSHOT).schema

    def build(rows):
        full = [{**DEFAULTS, **row} for row in rows]
        return spark.createDataFrame(
            [tuple(row.get(f.name) for f in schema.fields) for row in full], schema
        )

    return build


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, schemas.CATEGORY_EDGE)


@pytest.fixture(scope="session")
def market(snapshots, edges):
    def build(rows):
        return Marketplace(products=snapshots(rows), categories=edges)

    return build


def at(day, hour=12, minute=0, month=1):
    return dt.datetime(2024, month, day, hour, minute)
