import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LINE_SCHEMA = (
    "period string, receipt_id string, cashier_id string, store_id string, product_id string, "
    "date_str string, time_str string, payment_method_code string, line_total double, "
    "weight double, total_discounts double, is_item_void boolean, is_abort boolean"
)


@pytest.fixture(scope="session")
def make_lines(spark):
    """Lines from dicts; unnamed columns get an unremarkable value."""
    usual = {
        "period": "2026-02", "receipt_id": "r1", "cashier_id": "c1", "store_id": "s1",
        "product_id": "p1", "date_str": "20260205", "time_str": "10:00",
        "payment_method_code": "01", "line_total": 10.0, "weight": None,
        "total_discounts": 0.0, "is_item_void": False, "is_abort": False,
    }

    def build(*rows):
        names = list(usual)
        return spark.createDataFrame([tuple({**usual, **r}[n] for n in names) for r in rows], LINE_SCHEMA)

    return build


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
